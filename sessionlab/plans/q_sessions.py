"""Queries: sources, normalisers, sessionising, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import pack as P
from ..operators import sessionize as Z
from ..schema import GAP_COUNTS, OUTCOME_COUNTS, ROUTE_COUNTS, SESSION_KEYS
from . import fixtures as X
from .registry import query, r6, ts
from .sql_base import KEYS, RAW, SESSIONS


@query("sess_events", f"""WITH {SESSIONS}
SELECT {KEYS}, observation_id, seq_no, {ts('event_time')} AS event_time, {ts('prev_time')} AS prev_time,
       dt_ms, dt_bucket, token FROM ev""")
def sess_events(spark, sf):
    ev = Z.sessionize(X.base_events(spark, sf), X.GAP_MINUTES)
    return ev.select(*SESSION_KEYS, "observation_id", "seq_no", "event_time", "prev_time", "dt_ms", "dt_bucket", "token")


@query("joined_events", f"""WITH {RAW}
SELECT observation_id, user_id, client_name, session_id, {ts('event_time')} AS event_time, obs_name, level, route
FROM base""")
def joined_events(spark, sf):
    return X.base_events(spark, sf).select(
        "observation_id", "user_id", "client_name", "session_id", "event_time", "obs_name", "level", "route")


@query("route_group", f"""WITH {RAW}
SELECT route, route_group, count(*) AS n FROM base GROUP BY ALL""")
def route_group(spark, sf):
    return X.base_events(spark, sf).groupBy("route", "route_group").agg(F.count("*").alias("n"))


@query("outcome_class", f"""WITH {RAW}
SELECT obs_name, level, outcome_class, count(*) AS n FROM base GROUP BY ALL""")
def outcome_class(spark, sf):
    return X.base_events(spark, sf).groupBy("obs_name", "level", "outcome_class").agg(F.count("*").alias("n"))


@query("dt_bucket", f"""WITH {SESSIONS}
SELECT dt_bucket, count(*) AS n, min(dt_ms) AS least, max(dt_ms) AS most FROM ev GROUP BY ALL""")
def dt_bucket(spark, sf):
    return X.session_events(spark, sf).groupBy("dt_bucket").agg(
        F.count("*").alias("n"), F.min("dt_ms").alias("least"), F.max("dt_ms").alias("most"))


@query("sess_rollup", f"""WITH {SESSIONS}
SELECT {KEYS}, {ts('min(event_time)')} AS session_start, {ts('max(event_time)')} AS session_end, count(*) AS n_events
FROM ev GROUP BY {KEYS}""")
def sess_rollup(spark, sf):
    return Z.rollup(X.session_events(spark, sf)).orderBy("session_start")


def _count(col: str, values) -> str:
    return ", ".join(f"count(*) FILTER ({col} = '{v}') AS n_{v}" for v in values)


FEATURES = f"""f0 AS (
  SELECT {KEYS}, min(event_time) AS session_start, max(event_time) AS session_end, count(*) AS n_events,
    {_count('outcome_class', OUTCOME_COUNTS)}, {_count('route_group', ROUTE_COUNTS)}, {_count('dt_bucket', GAP_COUNTS)},
    count(DISTINCT token) AS n_unique_tokens
  FROM ev GROUP BY {KEYS} HAVING count(*) >= 5
),
feat AS (
  SELECT *, n_events / (duration_s + 1) AS events_per_s, n_error / n_events AS error_ratio,
    n_t_fast / n_events AS fast_ratio, n_t_idle / n_events AS idle_ratio,
    n_unique_tokens / n_events AS unique_token_ratio
  FROM (SELECT *, date_diff('second', session_start, session_end) AS duration_s FROM f0)
)"""


@query("sess_features", f"""WITH {SESSIONS}, {FEATURES}
SELECT * REPLACE ({ts('session_start')} AS session_start, {ts('session_end')} AS session_end,
  {r6('events_per_s')} AS events_per_s, {r6('error_ratio')} AS error_ratio, {r6('fast_ratio')} AS fast_ratio,
  {r6('idle_ratio')} AS idle_ratio, {r6('unique_token_ratio')} AS unique_token_ratio) FROM feat""")
def sess_features(spark, sf):
    return Z.session_features(Z.sessionize(X.one_project(spark, sf), X.GAP_MINUTES))


@query("day_key_sessions", f"""WITH {RAW}, d AS (
  SELECT *, strftime(event_time, '%Y-%m-%d') AS day FROM base)
SELECT client_name, day, user_id,
  CASE WHEN session_id IS NOT NULL THEN 'sid:' || session_id ELSE 'gap:' || day END AS session_key,
  {ts('min(event_time)')} AS session_start, {ts('max(event_time)')} AS session_end, count(*) AS n_events
FROM d GROUP BY ALL""")
def day_key_sessions(spark, sf):
    return Z.rollup(Z.day_key_sessions(X.one_project(spark, sf)))


@query("daily_sessions", f"""WITH {RAW}, d AS (
  SELECT *, strftime(event_time + INTERVAL 9 HOUR, '%Y-%m-%d') AS d,
    lag(event_time) OVER p AS prev_any
  FROM base WINDOW p AS (PARTITION BY user_id, client_name, session_id IS NOT NULL, coalesce(session_id, ''),
    strftime(event_time + INTERVAL 9 HOUR, '%Y-%m-%d') ORDER BY event_time, observation_id)),
e AS (SELECT *, sum(CASE WHEN prev_any IS NULL OR (session_id IS NULL AND date_diff('minute', prev_any, event_time) >= 120)
    THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, client_name, session_id IS NOT NULL, coalesce(session_id, ''), d
    ORDER BY event_time, observation_id) AS no FROM d)
SELECT client_name, d AS day, user_id,
  CASE WHEN session_id IS NOT NULL THEN 'sid:' || session_id ELSE 'gap:' || CAST(no AS BIGINT) END AS session_key,
  {ts('min(event_time)')} AS session_start, {ts('max(event_time)')} AS session_end, count(*) AS n_events
FROM e GROUP BY ALL""")
def daily_sessions(spark, sf):
    ev = Z.sessionize(X.one_project(spark, sf), 120, split_days=True, tz="Asia/Seoul")
    return Z.rollup(ev)


@query("two_projects", f"""WITH {SESSIONS}, r AS (SELECT client_name, day, user_id, session_key, min(event_time) AS t0, max(event_time) AS t1, count(*) AS n_events, count(DISTINCT token) AS tokens FROM ev GROUP BY ALL)
SELECT 'p0' AS project_id, client_name, day, user_id, session_key, {ts('t0')} AS session_start, {ts('t1')} AS session_end, n_events, tokens FROM r
UNION ALL SELECT 'p1', client_name, strftime(CAST(day AS TIMESTAMP) + INTERVAL 7 DAY, '%Y-%m-%d'), user_id, session_key, {ts('t0 + INTERVAL 7 DAY')}, {ts('t1 + INTERVAL 7 DAY')}, n_events, tokens
FROM r WHERE CAST(user_id AS BIGINT) % 2 = 0""")
def two_projects(spark, sf):
    """Equal users, clients and session ids of two projects are sessions of their own, in packed form too."""
    p = P.pack_numbered(Z.sessionize(X.two_projects(spark, sf), X.GAP_MINUTES), chunk_events=20)
    key = ["project_id", *SESSION_KEYS]
    ev = P.unpack(p)
    return ev.groupBy(*key).agg(F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"), F.count("*").alias("n_events"), F.count_distinct("token").alias("tokens"))


@query("user_norm", """WITH r AS (
  SELECT event_id, CASE WHEN user_id % 3 = 0 THEN ' ' WHEN user_id % 3 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS u,
    CASE WHEN user_id % 5 < 2 THEN '' ELSE 'api_' || user_id END AS m1,
    CASE WHEN user_id % 7 < 3 THEN '  ' ELSE 'end_' || user_id END AS m2,
    CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 's' || (event_id % 10) END AS s FROM events)
SELECT event_id, CASE WHEN u <> '' THEN u WHEN m1 <> '' THEN m1 ELSE m2 END AS user_first,
  CASE WHEN trim(u) <> '' THEN u WHEN trim(m1) <> '' THEN m1 WHEN trim(m2) <> '' THEN m2 ELSE 'UNKNOWN_USER' END AS user_spec,
  CASE WHEN trim(s) <> '' THEN s ELSE 'trace:' || event_id END AS session_spec FROM r""")
def user_norm(spark, sf):
    u = F.col("user_id")
    r = X.read(spark, sf, "events").select(
        "event_id",
        F.when(u % 3 == 0, " ").when(u % 3 == 1, "").otherwise(u.cast("string")).alias("u"),
        F.create_map(
            F.lit(C.META_USER[0]), F.when(u % 5 < 2, "").otherwise(F.concat(F.lit("api_"), u.cast("string"))),
            F.lit(C.META_USER[1]), F.when(u % 7 < 3, "  ").otherwise(F.concat(F.lit("end_"), u.cast("string")))).alias("m"),
        F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit("s"), (F.col("event_id") % 10).cast("string"))).alias("s"))
    return r.select("event_id", C.user_id(F.col("u"), F.col("m")).alias("user_first"),
                    C.user_id_or_unknown(F.col("u"), F.col("m")).alias("user_spec"),
                    C.session_id_or_trace(F.col("s"), F.col("event_id").cast("string")).alias("session_spec"))


@query("boundary_diff", """SELECT l_orderkey, l_linenumber, count(*) AS n,
  sum(date_diff('minute', l_shipdate, l_shipdate + to_seconds(CAST(l_extendedprice AS BIGINT)))) AS minutes,
  sum(date_diff('second', l_shipdate, l_shipdate + to_milliseconds(CAST(l_extendedprice * 100 AS BIGINT)))) AS seconds
FROM lineitem GROUP BY ALL""")
def boundary_diff(spark, sf):
    t0 = F.col("l_shipdate").cast("timestamp")
    us = F.unix_micros(t0)
    t1 = F.timestamp_micros(us + F.bround("l_extendedprice", 0).cast("long") * 1_000_000)
    t2 = F.timestamp_micros(us + F.bround(F.col("l_extendedprice") * 100, 0).cast("long") * 1000)
    return X.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.sum(C.boundaries(t0, t1, 60_000_000)).alias("minutes"),
        F.sum(C.boundaries(t0, t2, 1_000_000)).alias("seconds"))


@query("key_filter", f"""WITH {SESSIONS}
SELECT {KEYS}, count(*) AS n FROM ev
WHERE (user_id, client_name, session_key) IN (SELECT (user_id, client_name, session_key) FROM ev WHERE outcome_class = 'auth_fail')
GROUP BY {KEYS}""")
def key_filter(spark, sf):
    ev = X.session_events(spark, sf)
    return Z.with_keys(ev, ev.where(F.col("outcome_class") == "auth_fail")).groupBy(*SESSION_KEYS).agg(F.count("*").alias("n"))


@query("client_filter", f"""WITH {RAW}
SELECT client_name, count(*) AS n FROM base WHERE client_name IN ('client_1', 'client_3') GROUP BY ALL""")
def client_filter(spark, sf):
    return X.base_events(spark, sf).where(F.col("client_name").isin("client_1", "client_3")) \
        .groupBy("client_name").agg(F.count("*").alias("n"))


@query("spec_route", f"""WITH {RAW} SELECT observation_id, CASE WHEN k % 5 = 0 THEN 'UNKNOWN_ROUTE' WHEN coalesce(route, '') <> '' THEN route ELSE obs_name END AS route FROM (
  SELECT observation_id, CASE WHEN k % 5 <> 0 THEN route END AS route, obs_name, k FROM named)""")
def spec_route(spark, sf):
    t = F.col("created_at")
    o = X.observations(spark, sf).where((t >= F.lit(X.START).cast("timestamp")) & (t < F.lit(X.END).cast("timestamp")))
    gone = F.col("k") % 5 == 0
    return o.select(F.col("id").alias("observation_id"), C.route_or_name(
        F.when(gone, "  ").otherwise(F.col("metadata")[C.META_ROUTE]), F.when(gone, "").otherwise(F.col("name"))).alias("route"))


@query("token_repair", """SELECT doc_id, CASE WHEN trim(source) = 'web' THEN 'crawl' WHEN trim(lang) = 'en' THEN 'english' ELSE lang END AS fixed FROM (SELECT doc_id, source, lang FROM documents)
  WHERE 1 = 1""")
def token_repair(spark, sf):
    d = X.read(spark, sf, "documents")
    return d.select("doc_id", F.when(F.trim("source") == "web", C.repair(F.concat(F.lit(" "), "source"), {"web": "crawl"}))
                    .otherwise(C.repair(F.concat("lang", F.lit("  ")), {"en": "english"})).alias("fixed"))


@query("parsed_times", """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 3 = 0 AS bad FROM orders)
SELECT o_orderkey, d || ' 01:02:03' AS first, CASE WHEN bad THEN '-' ELSE d || ' 00:00:00' END AS second, 2 AS n FROM o""")
def parsed_times(spark, sf):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.array(F.concat(d, F.lit(" 01:02:03")), F.when(F.col("o_orderkey") % 3 == 0, "no time").otherwise(d))
    t = X.read(spark, sf, "orders").select("o_orderkey", C.parse_times(raw).alias("t"))
    text = [F.coalesce(F.date_format(F.col("t")[i], "yyyy-MM-dd HH:mm:ss"), F.lit("-")) for i in (0, 1)]
    return t.select("o_orderkey", text[0].alias("first"), text[1].alias("second"), F.size("t").alias("n"))

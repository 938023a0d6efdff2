"""Queries: packing, drilldown, rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import drilldown as D
from ..operators import pack as P
from ..operators import risk as R
from ..operators import scan
from ..operators import sessionize as Z
from ..profiles import SPEC
from ..schema import SESSION_KEYS
from ..staging import materialize
from . import fixtures as X
from . import spec_artifacts as A
from .registry import query, r6, ts
from .sql_base import KEYS, SESSIONS

W = X.WINDOW_S


def _list(col: str) -> str:
    return f"string_agg({col}, ' ' ORDER BY seq_no)"


@query("pack", f"""WITH {SESSIONS}
SELECT {KEYS}, (seq_no // 20) AS chunk, {_list("strftime(event_time, '%Y-%m-%dT%H:%M:%S')")} AS event_time,
  {_list('CAST(seq_no AS VARCHAR)')} AS observation_id, {_list('route_group')} AS route_group,
  {_list('outcome_class')} AS outcome_class, {_list('token')} AS token, {_list('dt_bucket')} AS dt_bucket
FROM ev GROUP BY {KEYS}, seq_no // 20""")
def pack(spark, sf):
    p = P.pack_numbered(X.session_events(spark, sf), chunk_events=20)
    return p.withColumn("observation_id", F.transform("observation_id", lambda x: x.cast("string"))).withColumn(
        "event_time", F.transform("event_time", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")))


@query("pack_roundtrip", f"""WITH {SESSIONS}
SELECT {KEYS}, seq_no, {ts('event_time')} AS event_time, route_group, outcome_class, token, dt_bucket FROM ev""")
def pack_roundtrip(spark, sf):
    return P.unpack(P.pack_numbered(X.session_events(spark, sf), chunk_events=20)).select(
        *SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome_class", "token", "dt_bucket")


@query("packed_features", f"""WITH {SESSIONS}
SELECT {KEYS}, count(*) AS n_events, count(*) FILTER (outcome_class = 'rate_limited') AS n_rate_limited,
  count(*) FILTER (route_group = 'chat') AS n_chat, count(DISTINCT token) AS n_unique_tokens
FROM ev GROUP BY {KEYS} HAVING count(*) >= 5""")
def packed_features(spark, sf):
    return Z.features_from_packed(P.pack_numbered(X.session_events(spark, sf))).select(
        *SESSION_KEYS, "n_events", "n_rate_limited", "n_chat", "n_unique_tokens")


CONV = """conv AS (SELECT CAST(conv_id AS VARCHAR) AS session_key, turn, role, text,
    CASE WHEN length(text) % 5 = 0 THEN 'error' ELSE 'ok' END AS outcome,
    make_timestamp(1704067200000000 + conv_id * 60000000 + turn * (length(text) % 40) * 1000000) AS tm,
    'client_' || (conv_id % 3) AS client_name, 'u' || (conv_id % 7) AS user_id
  FROM conversations)"""


def conversations(spark, sf):
    c = X.read(spark, sf, "conversations")
    n = F.length("text")
    return c.select(
        F.col("conv_id").cast("string").alias("session_key"), F.col("turn").alias("event_id"), F.col("role").alias("route_groups"),
        F.when(n % 5 == 0, "error").otherwise("ok").alias("outcomes"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("conv_id") * 60000000 + F.col("turn") * (n % 40) * 1000000).alias("ts"),
        F.concat(F.lit("client_"), (F.col("conv_id") % 3).cast("string")).alias("client_name"),
        F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"))


@query("pack_conversations", f"""WITH {CONV},
n AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY tm, turn) - 1 AS seq_no FROM conv)
SELECT client_name, '2024-01-01' AS day, user_id, session_key, 0 AS chunk, {_list('role')} AS route_group, {_list('outcome')} AS outcome_class,
  {_list("role || ':' || outcome")} AS token, {_list('CAST(seq_no AS VARCHAR)')} AS observation_id, 'event_level' AS source_mode
FROM n GROUP BY client_name, user_id, session_key""")
def pack_conversations(spark, sf):
    return P.pack(conversations(spark, sf), "2024-01-01").withColumn(
        "observation_id", F.transform("observation_id", lambda x: x.cast("string"))).drop("event_time")


@query("shape_test", f"""WITH {SESSIONS}
SELECT 'events' AS input, 'event_level' AS shape, count(*) AS n FROM ev
UNION ALL SELECT 'packed', 'packed_session', count(DISTINCT ({KEYS})) FROM ev
UNION ALL SELECT 'rows', 'session_fallback', count(DISTINCT ({KEYS})) FROM ev""")
def shape_test(spark, sf):
    ev = X.session_events(spark, sf)
    # `day` is left out of the three-column key, so sessions are tested as (client, day) clients here.
    inputs = {"events": ev, "packed": P.pack_numbered(ev), "rows": Z.rollup(ev)}
    parts = [df.groupBy(F.lit(name).alias("input"), F.lit(P.shape_of(df, SESSION_KEYS)).alias("shape"))
             .agg(F.count("*").alias("n")) for name, df in inputs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("number_rows", """SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice) - 1 AS seq_no FROM lineitem""")
def number_rows(spark, sf):
    li = X.read(spark, sf, "lineitem").withColumn("at", F.col("l_shipdate").cast("timestamp"))
    cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    return scan.number_rows(li, ["l_suppkey"], "at", cols, slot_us=30 * 86_400_000_000).select("l_suppkey", *cols, "seq_no")


@query("array_cut", """WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_suppkey) AS p,
    list(l_suppkey ORDER BY l_suppkey) FILTER (l_returnflag <> 'N') AS s, list(l_linenumber ORDER BY l_linenumber) FILTER (l_discount > 0.03) AS d
  FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, len(p) AS np, coalesce(len(s), 0) AS ns, coalesce(len(d), 0) AS nd FROM a)
SELECT l_orderkey, least(np, ns, nd) AS min_len, np AS len_p, np - least(np, ns, nd) AS cut_p, ns - least(np, ns, nd) AS cut_s,
  coalesce(list_sum(p[1:least(np, ns, nd)]), 0) AS sum_p,
  CASE WHEN least(np, ns, nd) = 0 THEN 'EMPTY_SESSION' ELSE '' END AS exclude_reason FROM m""")
def array_cut(spark, sf):
    li = X.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))), lambda s: s.l_partkey).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("l_discount") > 0.03, F.col("l_linenumber")))).alias("d"))
    arrays = ["p", "s", "d"]
    m = P.explode_meta(li, arrays, arrays)
    x = R.excluded(li, ["l_orderkey"], arrays).select("l_orderkey", "exclude_reason")
    return P.cut_arrays(m, arrays).join(x, "l_orderkey", "left").select(
        "l_orderkey", F.col("explode_meta.min_len").alias("min_len"), F.col("explode_meta.original_lengths")["p"].alias("len_p"),
        F.col("explode_meta.truncated_counts")["p"].alias("cut_p"), F.col("explode_meta.truncated_counts")["s"].alias("cut_s"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, b: a + b).alias("sum_p"), F.coalesce("exclude_reason", F.lit("")).alias("exclude_reason"))


PEAK = f"""pk0 AS (SELECT a.client_name, a.day, a.user_id, a.session_key, a.event_time AS peak_end, count(*) AS peak_events, min(b.event_time) AS peak_start
  FROM ev a JOIN ev b ON a.client_name = b.client_name AND a.day = b.day AND a.user_id = b.user_id AND a.session_key = b.session_key
    AND b.event_time BETWEEN a.event_time - INTERVAL {W} SECOND AND a.event_time GROUP BY ALL),
pk AS (SELECT {KEYS}, peak_events, peak_start, peak_end FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY peak_events DESC, peak_end) AS i FROM pk0) WHERE i = 1)"""


@query("peak_window", f"""WITH {SESSIONS}, {PEAK}
SELECT {KEYS}, peak_events, {ts('peak_start')} AS peak_start, {ts('peak_end')} AS peak_end FROM pk""")
def peak_window(spark, sf):
    return D.peak_window(X.session_events(spark, sf), window_s=W)


GAPS = f"""gaps AS (SELECT {KEYS}, quantile_cont(g, 0.5) AS p50_gap_s, quantile_cont(g, 0.95) AS p95_gap_s
  FROM (SELECT {KEYS}, date_diff('microsecond', prev_time, event_time) / 1e6::DOUBLE AS g FROM ev WHERE prev_time IS NOT NULL) GROUP BY {KEYS})"""


def gap_us(q: str) -> str:
    return f"round({q}_gap_s * 1e6::DOUBLE, 2) + 0.0 AS {q}_gap_us"


def gaps_in_us(df):
    """Gap quantiles in microseconds with two places, which hold them exactly."""
    return df.withColumns({f"{q}_gap_us": F.round(F.col(f"{q}_gap_s") * 1e6, 2) for q in ("p50", "p95")}).drop("p50_gap_s", "p95_gap_s")


@query("gap_quantiles", f"""WITH {SESSIONS}, {GAPS}
SELECT {KEYS}, {gap_us('p50')}, {gap_us('p95')} FROM gaps""")
def gap_quantiles(spark, sf):
    return gaps_in_us(D.gap_quantiles(X.session_events(spark, sf)))


ERR = "regexp_matches(outcome_class, 'fail|error|deny|blocked|429|5xx', 'i')"
RL = "regexp_matches(outcome_class, 'rate_limited|429', 'i')"


def _top3(col: str) -> str:
    return f"""t_{col} AS (SELECT {KEYS}, string_agg({col} || '(' || c || ')', ', ' ORDER BY i) AS top_{col} FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY c DESC, {col}) AS i FROM (
    SELECT {KEYS}, {col}, count(*) AS c FROM dv GROUP BY ALL)) WHERE i <= 3 GROUP BY {KEYS})"""


def _t(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


DRILL = f"""want AS (SELECT {KEYS} FROM ev GROUP BY {KEYS} ORDER BY count(*) DESC, {KEYS} LIMIT 100),
dv AS (SELECT ev.* FROM ev JOIN want USING ({KEYS})), {_top3('token')}, {_top3('route_group')}, {_top3('outcome_class')}, {_top3('dt_bucket')},
{PEAK}, {GAPS},
er0 AS (SELECT {KEYS}, route_group, count(*) AS c FROM dv WHERE {ERR} GROUP BY ALL),
er AS (SELECT {KEYS}, route_group || '(' || c || ')' AS top_error_route FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY c DESC, route_group) AS i FROM er0) WHERE i = 1),
sk AS (SELECT {KEYS}, max(c) AS top_route FROM (SELECT {KEYS}, route_group, count(*) AS c FROM dv GROUP BY ALL) GROUP BY ALL),
dd0 AS (SELECT {KEYS}, count(*) AS n_events_dd, count(DISTINCT token) AS n_tokens_dd, count(DISTINCT outcome_class) AS n_outcomes_dd,
  avg(CAST({ERR} AS INTEGER)) AS error_rate_dd, avg(CAST({RL} AS INTEGER)) AS rate_limited_rate_dd, min(event_time) AS first_ts, max(event_time) AS last_ts FROM dv GROUP BY {KEYS}),
dd1 AS (SELECT *, top_route / n_events_dd AS route_skew, peak_events / (n_events_dd + 1e-9::DOUBLE) AS burst_score, coalesce(top_error_route, '') AS ter
  FROM dd0 JOIN t_token USING ({KEYS}) JOIN t_route_group USING ({KEYS}) JOIN t_outcome_class USING ({KEYS}) JOIN t_dt_bucket USING ({KEYS})
  JOIN pk USING ({KEYS}) LEFT JOIN gaps USING ({KEYS}) LEFT JOIN er USING ({KEYS}) JOIN sk USING ({KEYS})),
dd AS (SELECT {KEYS}, n_events_dd, n_tokens_dd, n_outcomes_dd, top_token AS token_top3, top_route_group AS route_group_top3,
  top_outcome_class AS outcome_top3, top_dt_bucket AS dt_bucket_top3, {r6('error_rate_dd')} AS error_rate_dd, {r6('rate_limited_rate_dd')} AS rate_limited_rate_dd,
  {r6('route_skew')} AS route_skew, printf('%.0f%%', route_skew * 100) AS route_skew_pct, {r6('burst_score')} AS burst_score,
  {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts, {ts('peak_start')} AS peak_30s_start, {ts('peak_end')} AS peak_30s_end,
  peak_events AS peak_30s_events, CAST(peak_events AS DOUBLE) AS max_events_in_30s, {gap_us('p50')}, {gap_us('p95')},
  ter AS top_error_route, concat_ws(' | ', 'span=' || {_t('first_ts')} || '~' || {_t('last_ts')},
    'peak30s=' || peak_events || '@' || {_t('peak_start')} || '~' || {_t('peak_end')}, CASE WHEN ter <> '' THEN 'top_error_route=' || ter END,
    'error_rate=' || printf('%.0f%%', error_rate_dd * 100), 'rate_limited_rate=' || printf('%.0f%%', rate_limited_rate_dd * 100)) AS timeline_1line FROM dd1)"""


def longest(ev, k=100):
    return ev.groupBy(*SESSION_KEYS).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *SESSION_KEYS).limit(k)


@query("drilldown", f"WITH {SESSIONS}, {DRILL} SELECT * FROM dd")
def drilldown(spark, sf):
    ev = X.session_events(spark, sf)
    return gaps_in_us(D.drilldown(ev, longest(ev), window_s=W))


@query("drilldown_packed", f"WITH {SESSIONS}, {DRILL} SELECT * FROM dd")
def drilldown_packed(spark, sf):
    ev = X.session_events(spark, sf)
    return gaps_in_us(D.drilldown_packed(P.pack_numbered(ev, chunk_events=20), longest(ev), window_s=W))


ARRAYS_SQL = f"""WITH {SESSIONS}, {DRILL}
SELECT {KEYS}, n_events_dd, n_tokens_dd, n_outcomes_dd, token_top3, route_group_top3, outcome_top3, '' AS dt_bucket_top3, error_rate_dd,
  rate_limited_rate_dd, {r6('top_route / (n_events_dd + 1e-9::DOUBLE)')} AS route_skew, printf('%.0f%%', top_route / (n_events_dd + 1e-9::DOUBLE) * 100) AS route_skew_pct, 0 AS peak_30s_events, '' AS top_error_route, '' AS timeline_1line FROM dd JOIN sk USING ({KEYS})"""
UNTIMED = ("burst_score", "first_ts", "last_ts", "peak_30s_start", "peak_30s_end", "max_events_in_30s", "p50_gap_s", "p95_gap_s")


@query("drilldown_arrays", ARRAYS_SQL)
def drilldown_arrays(spark, sf):
    ev = X.session_events(spark, sf)
    return D.drilldown_arrays(P.pack_numbered(ev), longest(ev)).drop(*UNTIMED)


@query("drilldown_arrays_chunks", ARRAYS_SQL)
def drilldown_arrays_chunks(spark, sf):
    """Sessions of several packed rows."""
    ev = X.session_events(spark, sf)
    return D.drilldown_arrays(P.pack_numbered(ev, chunk_events=20), longest(ev)).drop(*UNTIMED)


@query("histograms", f"""WITH {SESSIONS},
c AS (SELECT {KEYS}, route_group, count(*) AS c FROM ev GROUP BY ALL)
SELECT {KEYS}, string_agg(route_group || '=' || c || '/' || printf('%.2f', share), ' ' ORDER BY route_group) AS routes
FROM (SELECT *, c / sum(c) OVER (PARTITION BY {KEYS}) AS share FROM c) GROUP BY {KEYS}""")
def histograms(spark, sf):
    h = D.histogram(X.session_events(spark, sf), SESSION_KEYS, "route_group", "h")
    return h.select(*SESSION_KEYS, F.transform(F.map_entries("h"), lambda e: F.concat(
        e.key, F.lit("="), e.value["count"].cast("string"), F.lit("/"), C.fixed(e.value["share"]))).alias("routes"))


# Raw signals in the spelling of the specification, derived from the events.
RAW_SIGNAL = """CASE WHEN e.k % 23 = 0 THEN 'Timeout' WHEN e.k % 19 = 0 THEN ' CANCELED ' WHEN obs_name = 'litellm-rate_limit_exceed' AND level = 'ERROR' THEN 'level:error|http:429'
  WHEN obs_name = 'litellm-rate_limit_exceed' THEN 'http:429|level:INFO' WHEN obs_name = 'litellm-internal_error' THEN 'HTTP:503'
  WHEN obs_name = 'litellm-bad_request_error' THEN 'http:400|note:x' WHEN obs_name = 'litellm-auth_error' THEN 'http:302'
  WHEN level = 'ERROR' THEN 'level:ERROR' WHEN e.k % 2 = 0 THEN 'OK' ELSE 'something' END"""


def signals(ev):
    k, name = F.col("k"), F.col("obs_name")
    return (F.when(k % 23 == 0, "Timeout").when(k % 19 == 0, " CANCELED ")
            .when((name == "litellm-rate_limit_exceed") & (F.col("level") == "ERROR"), "level:error|http:429")
            .when(name == "litellm-rate_limit_exceed", "http:429|level:INFO").when(name == "litellm-internal_error", "HTTP:503")
            .when(name == "litellm-bad_request_error", "http:400|note:x").when(name == "litellm-auth_error", "http:302")
            .when(F.col("level") == "ERROR", "level:ERROR").when(k % 2 == 0, "OK").otherwise("something"))


PARSED = """CASE WHEN regexp_matches(trim(raw), '^(ok|error|rate_limited|timeout|canceled)$', 'i') THEN lower(trim(raw))
  WHEN regexp_matches(raw, '(^|\\|)http:429($|\\|)', 'i') THEN 'rate_limited' WHEN regexp_matches(raw, '(^|\\|)http:[45][0-9][0-9]($|\\|)', 'i') THEN 'error'
  WHEN regexp_matches(raw, '(^|\\|)level:error($|\\|)', 'i') THEN 'error' ELSE 'ok' END"""

SIGNALS = f"""sg AS (SELECT ev.*, {RAW_SIGNAL} AS raw FROM ev JOIN (SELECT CAST(event_id AS VARCHAR) AS observation_id, k FROM raw) e USING (observation_id)),
sp AS (SELECT *, {PARSED} AS outcome FROM sg)"""


def spec_events(spark, sf):
    """Events with their signals, written once: rules, timelines and details read the same table."""
    ev = X.numbered_events(spark, sf)
    ev = ev.withColumn("raw", signals(ev)).withColumn("outcome", C.parse_outcome(F.col("raw")))
    return X.staged(spark, sf, "signals", lambda: ev.select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "token", "raw", "outcome"))


@query("outcome_parse", f"WITH {SESSIONS}, {SIGNALS} SELECT raw, outcome, count(*) AS n FROM sp GROUP BY ALL")
def outcome_parse(spark, sf):
    return spec_events(spark, sf).groupBy("raw", "outcome").agg(F.count("*").alias("n"))


@query("route_mask", r"""WITH r AS (SELECT page_id, url || '/' || md5(url) || '/' || substr(md5(html), 1, 8) || '-' || substr(md5(html), 9, 4) || '-' ||
  substr(md5(html), 13, 4) || '-' || substr(md5(html), 17, 4) || '-' || substr(md5(html), 21, 12) || '/runs/' || page_id AS path FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(path,
  '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', ':uuid', 'g'), '\b[0-9a-fA-F]{8,}\b', ':hex', 'g'), '\b[0-9]+\b', ':num', 'g') AS masked FROM r""")
def route_mask(spark, sf):
    h = F.md5("html")
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    path = F.concat_ws("/", "url", F.md5("url"), uuid, F.lit("runs"), F.col("page_id").cast("string"))
    return X.read(spark, sf, "pages").select("page_id", C.mask_route(path).alias("masked"))


@query("time_valid", """WITH s AS (SELECT l_orderkey, bool_and(year(l_shipdate) <> 1970 AND l_shipdate >= TIMESTAMP '1996-12-25' AND l_shipdate <= TIMESTAMP '1999-01-08') AS ok,
  min(l_shipdate) AS t0, any_value(o_orderdate) AS created FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT l_orderkey, CAST(ok AS BIGINT) AS time_valid, strftime(CASE WHEN ok THEN t0 ELSE created END + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM s""")
def time_valid(spark, sf):
    s = (X.read(spark, sf, "lineitem").join(X.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy("l_orderkey").agg(F.collect_list(F.col("l_shipdate").cast("timestamp")).alias("times"),
                                    F.max(F.col("o_orderdate").cast("timestamp")).alias("created")))
    ok = C.times_valid(F.col("times"), F.lit("1997-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp"))
    return s.select("l_orderkey", ok.alias("time_valid"),
                    C.local_day(F.when(ok, F.array_min("times")).otherwise(F.col("created")), "Asia/Seoul").alias("day"))


# Half of the run window is declared out of range, so that both kinds of sessions occur.
RULE_END = "2024-01-20"
RULES = f"""{SIGNALS}, {PEAK},
rf0 AS (SELECT {KEYS}, count(*) AS n_events, bool_and(event_time <= TIMESTAMP '{RULE_END}' + INTERVAL 7 DAY) AS time_valid, min(event_time) AS t0, max(event_time) AS t1,
  count(*) FILTER (outcome = 'ok') AS ok_count, count(*) FILTER (outcome = 'error') AS error_count, count(*) FILTER (outcome = 'rate_limited') AS rate_limited_count,
  min(event_time) FILTER (outcome = 'error') AS first_err, min(event_time) FILTER (outcome = 'rate_limited') AS first_rl FROM sp GROUP BY {KEYS}),
rc AS (SELECT {KEYS}, route_group, count(*) AS c FROM sp GROUP BY ALL),
rf AS (SELECT rf0.*, CASE WHEN time_valid THEN date_diff('microsecond', t0, t1) / 1e6::DOUBLE ELSE 0 END AS duration_sec, CASE WHEN time_valid THEN peak_events ELSE 0 END AS peak30s,
  CASE WHEN time_valid THEN 0 ELSE n_events END AS time_unreliable_count, error_count / n_events AS error_rate, rate_limited_count / n_events AS rate_limited_rate,
  (SELECT max(c) FROM rc WHERE rc.client_name = rf0.client_name AND rc.day = rf0.day AND rc.user_id = rf0.user_id AND rc.session_key = rf0.session_key) / n_events AS route_skew
  FROM rf0 JOIN pk USING ({KEYS})),
rs AS (SELECT *, greatest(0, least(1, (error_rate - 0.05::DOUBLE) / 0.35::DOUBLE)) AS s_error, greatest(0, least(1, (rate_limited_rate - 0.02::DOUBLE) / 0.30::DOUBLE)) AS s_rl,
  greatest(0, least(1, (peak30s - 8) / 20)) AS s_burst, greatest(0, least(1, (route_skew - 0.70::DOUBLE) / 0.30::DOUBLE)) AS s_route,
  greatest(0, least(1, (ln(1 + duration_sec) - ln(1801)) / (ln(21601) - ln(1801)))) AS s_long, error_rate = 0 AND rate_limited_rate < 0.02 AND duration_sec >= 3600 AS calm FROM rf),
rv AS (SELECT *, raw2 * CASE WHEN calm THEN 0.6::DOUBLE ELSE 1 END AS risk_score_v2 FROM (SELECT *, 100 * (0.35::DOUBLE * s_error + 0.25::DOUBLE * s_rl + 0.25::DOUBLE * s_burst + 0.10::DOUBLE * s_route + 0.05::DOUBLE * s_long) AS raw2 FROM rs)),
rt AS (SELECT *, error_rate >= 0.2 AS eh, rate_limited_rate >= 0.15 AS rh, peak30s >= 20 AS bu, peak30s >= 40 AS xb FROM rv),
ru AS (SELECT *, concat_ws(' ', CASE WHEN bu THEN 'BURST' END, CASE WHEN eh THEN 'ERROR_HEAVY' END, CASE WHEN xb THEN 'EXTREME_BURST' END, CASE WHEN duration_sec >= 7200 THEN 'LONG_DURATION' END,
  CASE WHEN calm THEN 'NORMAL_LONG_SESSION_HINT' END, CASE WHEN rh AND (route_skew >= 0.8 OR bu) THEN 'POLICY_PRESSURE' END, CASE WHEN rh THEN 'RATE_LIMIT_HEAVY' END,
  CASE WHEN (rh OR eh) AND bu THEN 'RETRY_STORM' END, CASE WHEN route_skew >= 0.9 THEN 'ROUTE_SKEW' END, CASE WHEN route_skew >= 0.95 AND n_events >= 20 THEN 'SINGLE_ROUTE_LOOP' END,
  CASE WHEN NOT time_valid THEN 'TIME_UNRELIABLE' END) AS risk_tags FROM rt),
rl AS (SELECT *, CASE WHEN NOT time_valid THEN 'TIME_UNRELIABLE' WHEN (rh OR eh) AND bu THEN CASE WHEN rate_limited_rate >= error_rate THEN 'RATE_LIMIT' ELSE 'ERROR' END WHEN xb THEN 'BURST'
    WHEN eh THEN 'ERROR' WHEN rh THEN 'RATE_LIMIT' WHEN route_skew >= 0.9 THEN 'ROUTE_SKEW' WHEN duration_sec >= 7200 THEN 'LONG' ELSE 'MIXED' END AS primary_reason_code,
  CASE WHEN risk_score_v2 >= 80 OR (xb AND (eh OR rh)) THEN 'suspicious' WHEN calm THEN 'benign_fp' WHEN risk_score_v2 >= 50 THEN 'needs_review' ELSE 'normal' END AS label_suggested FROM ru),
ra AS (SELECT *, CASE WHEN label_suggested = 'suspicious' AND bu THEN 'block_candidate' WHEN label_suggested = 'suspicious' AND rh THEN 'rate_limit_candidate'
    WHEN label_suggested IN ('suspicious', 'needs_review') THEN 'review' ELSE 'monitor' END AS action_suggested,
  CASE label_suggested WHEN 'suspicious' THEN least(1, 0.6::DOUBLE + 0.4::DOUBLE * greatest(0, least(1, (risk_score_v2 - 80) / 20))) WHEN 'needs_review' THEN 0.3::DOUBLE + 0.3::DOUBLE * greatest(0, least(1, (risk_score_v2 - 50) / 30))
    WHEN 'benign_fp' THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM rl)"""


def rule_rows(spark, sf):
    ev = spec_events(spark, sf).select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome")
    return R.with_labels(R.with_tags(R.with_risk_v2(R.rule_features(ev, SESSION_KEYS, X.START, RULE_END, window_s=W))))


@query("risk_v2", f"""WITH {SESSIONS}, {RULES}
SELECT {KEYS}, n_events, {r6('duration_sec')} AS duration_sec, {r6('error_rate')} AS error_rate, {r6('rate_limited_rate')} AS rate_limited_rate, peak30s, time_unreliable_count,
  {r6('route_skew')} AS route_skew, {r6('s_error')} AS s_error, {r6('s_rl')} AS s_rl, {r6('s_burst')} AS s_burst, {r6('s_route')} AS s_route, {r6('s_long')} AS s_long, {r6('raw2')} AS risk_score_v2_raw,
  {r6('risk_score_v2')} AS risk_score_v2 FROM rv""")
def risk_v2(spark, sf):
    ev = spec_events(spark, sf).select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome")
    f = R.with_risk_v2(R.rule_features(ev, SESSION_KEYS, X.START, RULE_END, window_s=W))
    return f.select(*SESSION_KEYS, "n_events", "duration_sec", "error_rate", "rate_limited_rate", "peak30s", "time_unreliable_count", "route_skew",
                    *R.WEIGHTS, "risk_score_v2_raw", "risk_score_v2")


@query("risk_tags", f"""WITH {SESSIONS}, {RULES} SELECT {KEYS}, risk_tags FROM ru""")
def risk_tags(spark, sf):
    return rule_rows(spark, sf).select(*SESSION_KEYS, "risk_tags")


@query("pseudo_labels", f"""WITH {SESSIONS}, {RULES}
SELECT {KEYS}, primary_reason_code, label_suggested, action_suggested, {r6('confidence')} AS confidence FROM ra""")
def pseudo_labels(spark, sf):
    return rule_rows(spark, sf).select(*SESSION_KEYS, "primary_reason_code", "label_suggested", "action_suggested", "confidence")


@query("rule_timeline", f"""WITH {SESSIONS}, {RULES},
tr AS (SELECT {KEYS}, string_agg(route_group || ':' || c || '(' || printf('%.2f', c / n) || ')', ', ' ORDER BY i) AS routes FROM (
  SELECT *, sum(c) OVER (PARTITION BY {KEYS}) AS n, row_number() OVER (PARTITION BY {KEYS} ORDER BY c DESC, route_group) AS i FROM rc) WHERE i <= 3 GROUP BY {KEYS}),
z AS (SELECT *, strftime(t0 + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS a, strftime(t1 + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS b,
  coalesce(strftime(first_err + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S'), '-') AS fe, coalesce(strftime(first_rl + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S'), '-') AS fr FROM rf JOIN tr USING ({KEYS}))
SELECT {KEYS}, CASE WHEN time_valid THEN a ELSE 'TIME_UNRELIABLE' END || '..' || CASE WHEN time_valid THEN b ELSE 'TIME_UNRELIABLE' END || ' (dur=' || printf('%.0f', duration_sec::DOUBLE) || 's); n=' || n_events ||
  '; peak30s=' || peak30s || '; routes=' || routes || '; outcomes=ok:' || ok_count || ' err:' || error_count || ' rl:' || rate_limited_count || '; first_err=' ||
  CASE WHEN time_valid THEN fe ELSE '-' END || '; first_rl=' || CASE WHEN time_valid THEN fr ELSE '-' END AS timeline_1line FROM z""")
def rule_timeline(spark, sf):
    ev = spec_events(spark, sf).select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome")
    f = R.rule_features(ev, SESSION_KEYS, X.START, RULE_END, window_s=W).join(R.top_routes(ev, SESSION_KEYS), list(SESSION_KEYS))
    return f.select(*SESSION_KEYS, R.rule_timeline().alias("timeline_1line"))


@query("triage", f"""WITH {SESSIONS}, {RULES}
SELECT {KEYS}, CASE WHEN error_rate = 0 THEN 'clean' WHEN error_rate <= 0.05 THEN 'ordinary_failures' WHEN error_rate <= 0.3 THEN 'retrying' ELSE 'runaway' END AS error_band,
  CASE WHEN peak30s < 5 THEN 'normal' WHEN peak30s <= 15 THEN 'active' WHEN peak30s < 40 THEN 'burst' ELSE 'automation' END AS peak_band,
  CASE WHEN route_skew <= 0.6 THEN 'spread' WHEN route_skew < 1 THEN 'focused' ELSE 'single_route' END AS skew_band,
  CAST(peak30s >= 20 AND error_rate >= 0.1 AND rate_limited_rate >= 0.1 AS BIGINT) AS retry_loop, CAST(duration_sec >= 3600 AND error_rate <= 0.05 AND route_skew >= 0.8 AS BIGINT) AS long_normal_session FROM rf""")
def triage(spark, sf):
    ev = spec_events(spark, sf).select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome")
    return R.with_triage(R.rule_features(ev, SESSION_KEYS, X.START, RULE_END, window_s=W)).select(
        *SESSION_KEYS, "error_band", "peak_band", "skew_band", "retry_loop", "long_normal_session")


@query("evasive_users", f"""WITH {SESSIONS}, {RULES}
SELECT client_name, user_id, count(*) FILTER (duration_sec <= 172800 AND rate_limited_rate >= 0.1 AND peak30s >= 5) AS limited_short_sessions, count(*) AS sessions,
  CAST(count(*) FILTER (duration_sec <= 172800 AND rate_limited_rate >= 0.1 AND peak30s >= 5) >= 1 AS BIGINT) AS limit_evasion FROM rf GROUP BY ALL""")
def evasive_users(spark, sf):
    ev = spec_events(spark, sf).select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome")
    return R.evasive_users(R.rule_features(ev, SESSION_KEYS, X.START, RULE_END, window_s=W), ("client_name", "user_id"), 172800.0, 1)


@query("rule_details", f"""WITH {SESSIONS}, {RULES}, h AS (SELECT {KEYS}, unnest([
    {{'t': 'BURST', 'ok': bu, 'v': CAST(peak30s AS DOUBLE)}}, {{'t': 'ERROR_HEAVY', 'ok': eh, 'v': error_rate}}, {{'t': 'EXTREME_BURST', 'ok': xb, 'v': CAST(peak30s AS DOUBLE)}},
    {{'t': 'LONG_DURATION', 'ok': duration_sec >= 7200, 'v': duration_sec}}, {{'t': 'NORMAL_LONG_SESSION_HINT', 'ok': calm, 'v': duration_sec}},
    {{'t': 'POLICY_PRESSURE', 'ok': rh AND (route_skew >= 0.8 OR bu), 'v': rate_limited_rate}}, {{'t': 'RATE_LIMIT_HEAVY', 'ok': rh, 'v': rate_limited_rate}},
    {{'t': 'RETRY_STORM', 'ok': (rh OR eh) AND bu, 'v': CAST(peak30s AS DOUBLE)}}, {{'t': 'ROUTE_SKEW', 'ok': route_skew >= 0.9, 'v': route_skew}},
    {{'t': 'SINGLE_ROUTE_LOOP', 'ok': route_skew >= 0.95 AND n_events >= 20, 'v': route_skew}}, {{'t': 'TIME_UNRELIABLE', 'ok': NOT time_valid, 'v': CAST(time_unreliable_count AS DOUBLE)}}]) AS x, s_error, raw2 FROM rt)
SELECT {KEYS}, x.t AS tag, {r6('x.v')} AS value, {r6('s_error')} AS s_error, 0.35::DOUBLE AS w_error, {r6('raw2')} AS raw FROM h WHERE x.ok""")
def rule_details(spark, sf):
    r = rule_rows(spark, sf).withColumn("b", R.component_breakdown())
    return r.select(*SESSION_KEYS, F.inline("threshold_hits"), "b").select(
        *SESSION_KEYS, "tag", "value", F.col("b.s_error").alias("s_error"), F.col("b.weights")["s_error"].alias("w_error"),
        F.col("b.risk_score_v2_raw").alias("raw"))


@query("review_log", f"""WITH {SESSIONS}, {RULES}, r AS (SELECT *, row_number() OVER (PARTITION BY client_name ORDER BY round(risk_score_v2, 9) DESC, session_key, user_id) AS rank FROM ra)
SELECT client_name || '/' || user_id || '/' || session_key AS review_id, day, user_id AS user_id_norm, session_key AS session_id_norm, rank, {r6('risk_score_v2')} AS risk_score_v2, label_suggested AS label,
  primary_reason_code AS reason_code, 'auto_accept' AS label_source FROM r WHERE rank <= 25""")
def review_log(spark, sf):
    import uuid

    from ..operators.stats import top_k
    from ..sources.writers import append_reviews
    from ..staging import shared_dir
    r = rule_rows(spark, sf).withColumn("risk_score_v2", F.round("risk_score_v2", 9))
    top = top_k(r, ["client_name"], [F.desc("risk_score_v2"), F.asc("session_key"), F.asc("user_id")], 25)
    log = top.select(F.concat_ws("/", "client_name", "user_id", "session_key").alias("review_id"), "day", F.col("user_id").alias("user_id_norm"),
                     F.col("session_key").alias("session_id_norm"), "rank", "risk_score_v2", "risk_tags", F.col("label_suggested").alias("label"),
                     F.col("primary_reason_code").alias("reason_code"), F.lit("auto_accept").alias("label_source"))
    path = f"{shared_dir(spark)}/reviews-{uuid.uuid4().hex}"
    append_reviews(log, path)
    return spark.read.parquet(path).select("review_id", "day", "user_id_norm", "session_id_norm", "rank", "risk_score_v2", "label", "reason_code", "label_source")


@query("excluded", """WITH a AS (SELECT o_orderkey, count(l_orderkey) FILTER (l_discount >= 0.09) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, 'EMPTY_SESSION' AS exclude_reason, 'EMPTY_SESSION' AS risk_tags, n AS min_len FROM a WHERE n = 0""")
def excluded(spark, sf):
    li = X.read(spark, sf, "lineitem").where(F.col("l_discount") >= 0.09).groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("items"))
    o = X.read(spark, sf, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return R.excluded(o, ["o_orderkey"], ["items"]).select("o_orderkey", "exclude_reason", "risk_tags", F.col("explode_meta.min_len").alias("min_len"))


HITS = f"""hit AS (SELECT {KEYS}, string_agg(x.t || '=' || printf('%.2f', x.v), ', ' ORDER BY x.t) AS hits FROM (SELECT {KEYS}, unnest([
    {{'t': 'BURST', 'ok': bu, 'v': CAST(peak30s AS DOUBLE)}}, {{'t': 'ERROR_HEAVY', 'ok': eh, 'v': error_rate}}, {{'t': 'EXTREME_BURST', 'ok': xb, 'v': CAST(peak30s AS DOUBLE)}},
    {{'t': 'LONG_DURATION', 'ok': duration_sec >= 7200, 'v': duration_sec}}, {{'t': 'NORMAL_LONG_SESSION_HINT', 'ok': calm, 'v': duration_sec}},
    {{'t': 'POLICY_PRESSURE', 'ok': rh AND (route_skew >= 0.8 OR bu), 'v': rate_limited_rate}}, {{'t': 'RATE_LIMIT_HEAVY', 'ok': rh, 'v': rate_limited_rate}},
    {{'t': 'RETRY_STORM', 'ok': (rh OR eh) AND bu, 'v': CAST(peak30s AS DOUBLE)}}, {{'t': 'ROUTE_SKEW', 'ok': route_skew >= 0.9, 'v': route_skew}},
    {{'t': 'SINGLE_ROUTE_LOOP', 'ok': route_skew >= 0.95 AND n_events >= 20, 'v': route_skew}}, {{'t': 'TIME_UNRELIABLE', 'ok': NOT time_valid, 'v': CAST(time_unreliable_count AS DOUBLE)}}]) AS x FROM rt)
  WHERE x.ok GROUP BY {KEYS})"""
SPEC_SUMMARY = f"""{SESSIONS}, {RULES}, {HITS},
trt AS (SELECT {KEYS}, string_agg(route_group || ':' || c || '(' || printf('%.2f', c / n) || ')', ', ' ORDER BY i) AS routes FROM (
  SELECT *, sum(c) OVER (PARTITION BY {KEYS}) AS n, row_number() OVER (PARTITION BY {KEYS} ORDER BY c DESC, route_group) AS i FROM rc) WHERE i <= 3 GROUP BY {KEYS}),
sq AS (SELECT client_name, quantile_cont(CAST(n_events AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(n_events AS DOUBLE), 0.95) AS p95 FROM ra GROUP BY ALL),
sm0 AS (SELECT ra.*, row_number() OVER (PARTITION BY client_name ORDER BY n_events DESC, round(risk_score_v2, 9) DESC, session_key, user_id, day) AS rank,
  CASE WHEN p95 > p50 THEN greatest(0, least(100, (n_events - p50) / (p95 - p50) * 100)) ELSE 0 END AS risk_score_if FROM ra JOIN sq USING (client_name)),
sm AS (SELECT sm0.*, routes, coalesce(hits, 'no rule') AS hits, n_events - CASE WHEN CAST(user_id AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS min_len,
  strftime(t0 + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS a, strftime(t1 + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS b,
  coalesce(strftime(first_err + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S'), '-') AS fe, coalesce(strftime(first_rl + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S'), '-') AS fr
  FROM sm0 JOIN trt USING ({KEYS}) LEFT JOIN hit USING ({KEYS}) WHERE rank <= 25)"""


def spec_inputs(spark, sf):
    """Rule rows with the number of events as score, events, and packed rows in which one outcome of every fifth user's sessions is missing."""
    ev = spec_events(spark, sf).select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome", "token")
    scored = materialize(rule_rows(spark, sf).withColumn("if_raw", F.col("n_events").cast("double")), "rules")
    packed = P.pack_numbered(X.session_events(spark, sf), chunk_events=20)
    lost = (F.col("user_id").cast("long") % 5 == 0) & (F.col("chunk") == 0)
    packed = packed.withColumn("outcome_class", F.when(lost, F.expr("slice(outcome_class, 1, size(outcome_class) - 1)")).otherwise(F.col("outcome_class")))
    return scored, ev, A.explode_meta(packed)


@query("spec_summary", f"""WITH {SPEC_SUMMARY}
SELECT {KEYS}, rank, n_events + 0.0 AS if_raw, {r6('risk_score_v2')} AS risk_score_v2, {r6('risk_score_if')} AS risk_score_if, n_events, {r6('duration_sec')} AS duration_sec, {r6('error_rate')} AS error_rate,
  {r6('rate_limited_rate')} AS rate_limited_rate, peak30s, {r6('route_skew')} AS route_skew, risk_tags, primary_reason_code, primary_reason_code || ': ' || hits AS why_ranked,
  CASE WHEN time_valid THEN a ELSE 'TIME_UNRELIABLE' END || '..' || CASE WHEN time_valid THEN b ELSE 'TIME_UNRELIABLE' END || ' (dur=' || printf('%.0f', duration_sec::DOUBLE) || 's); n=' || n_events ||
  '; peak30s=' || peak30s || '; routes=' || routes || '; outcomes=ok:' || ok_count || ' err:' || error_count || ' rl:' || rate_limited_count || '; first_err=' ||
  CASE WHEN time_valid THEN fe ELSE '-' END || '; first_rl=' || CASE WHEN time_valid THEN fr ELSE '-' END AS timeline_1line, min_len, min_len AS outcomes, n_events - min_len AS cut_tokens FROM sm""")
def spec_summary(spark, sf):
    scored, ev, metas = spec_inputs(spark, sf)
    s = A.spec_summary(scored, ev, metas, ("client_name",), profile=replace(SPEC, top_k=25))
    m = F.col("explode_meta")
    return s.withColumns({"min_len": m.min_len, "outcomes": m.original_lengths["outcome_class"], "cut_tokens": m.truncated_counts["token"]}).drop(
        "explode_meta", "threshold_hits", "component_breakdown")


SPEC_NUMBERS = ("n_events", "duration_sec", "error_rate", "rate_limited_rate", "peak30s", "route_skew")


@query("spec_drilldown", f"""WITH {SPEC_SUMMARY},
sf AS ({" UNION ALL ".join(f"SELECT {KEYS}, {i} AS i, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM ra" for i, c in enumerate(SPEC_NUMBERS))}),
sd AS (SELECT client_name, feature, quantile_cont(value, 0.5) AS med FROM sf GROUP BY ALL),
sa AS (SELECT client_name, feature, any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad FROM sf JOIN sd USING (client_name, feature) GROUP BY ALL),
dv AS (SELECT {KEYS}, string_agg(feature || ':' || CASE WHEN mad = 0 THEN '-' ELSE printf('%.3f', (value - med) / mad) END, ' ' ORDER BY i) AS deviations FROM sf JOIN sa USING (client_name, feature) GROUP BY {KEYS}),
hr AS (SELECT {KEYS}, string_agg(route_group || '=' || c, ' ' ORDER BY route_group) AS routes_h FROM rc GROUP BY {KEYS}),
ho AS (SELECT {KEYS}, string_agg(outcome || '=' || c, ' ' ORDER BY outcome) AS outcomes_h FROM (SELECT {KEYS}, outcome, count(*) AS c FROM sp GROUP BY ALL) GROUP BY {KEYS})
SELECT {KEYS}, chunk, timeline, CASE WHEN chunk = 0 THEN rank END AS rank, CASE WHEN chunk = 0 THEN hits END AS hits, CASE WHEN chunk = 0 THEN deviations END AS deviations,
  CASE WHEN chunk = 0 THEN routes_h END AS routes, CASE WHEN chunk = 0 THEN outcomes_h END AS outcomes, CASE WHEN chunk = 0 THEN min_len END AS min_len, CASE WHEN chunk = 0 THEN {r6('raw2')} END AS raw
FROM (SELECT {KEYS}, seq_no // 20 AS chunk, string_agg(strftime(event_time, '%Y-%m-%dT%H:%M:%S') || '|' || route_group || '|' || outcome || '|' || token, ' ' ORDER BY seq_no) AS timeline FROM sp GROUP BY {KEYS}, seq_no // 20)
JOIN sm USING ({KEYS}) JOIN dv USING ({KEYS}) JOIN hr USING ({KEYS}) JOIN ho USING ({KEYS})""")
def spec_drilldown(spark, sf):
    scored, ev, metas = spec_inputs(spark, sf)
    s = A.spec_summary(scored, ev, metas, ("client_name",), profile=replace(SPEC, top_k=25))
    d = A.spec_drilldown(s, scored, ev, ("client_name",), chunk_events=20)

    def told(col, text):
        return F.array_join(F.transform(col, text), " ")

    def counted(col):
        return told(F.map_entries(col), lambda e: F.concat(e.key, F.lit("="), e.value["count"].cast("string")))
    hits = F.when(F.size("threshold_hits") > 0, F.array_join(F.transform("threshold_hits", lambda h: F.concat(h.tag, F.lit("="), C.fixed(h.value))), ", ")).when(F.col("rank").isNotNull(), "no rule")
    return d.select(*SESSION_KEYS, "chunk", told("timeline", lambda e: F.concat_ws("|", F.date_format(e.t, "yyyy-MM-dd'T'HH:mm:ss"), e.route_group, e.outcome, e.token)).alias("timeline"), "rank", hits.alias("hits"),
                    told("top_feature_deviation", lambda x: F.concat(x.feature, F.lit(":"), F.coalesce(C.fixed(x.z, 3), F.lit("-")))).alias("deviations"),
                    counted("route_histogram").alias("routes"), counted("outcome_histogram").alias("outcomes"), F.col("explode_meta.min_len").alias("min_len"), F.col("component_breakdown.risk_score_v2_raw").alias("raw"))

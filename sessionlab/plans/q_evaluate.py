"""Queries: comparison of rankings, and input and output."""

from __future__ import annotations

import time
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import sequence as S
from ..operators import sessionize as Z
from ..operators import stats as St
from ..operators.forest import rank_by_forest
from ..profiles import IMPL
from ..schema import PARTITION_KEYS, SESSION_KEYS
from ..sources import readers, writers
from ..staging import materialize, shared_dir
from . import fixtures as X
from .q_ranking import weekly_features
from .q_sequences import B1_MEAN, B3
from .registry import query, r6, ts
from .sql_base import KEYS, SESSIONS, WEEKLY

PART = "client_name, day"
K = 20

SCORES = f"""{B1_MEAN},
tc AS (SELECT {KEYS}, token, count(*) AS c FROM ev GROUP BY ALL),
en AS (SELECT {KEYS}, greatest(ln(sum(c)) - sum(c * ln(c)) / sum(c), 0) AS h FROM tc GROUP BY {KEYS}),
lb AS (SELECT {KEYS}, CAST(max(CASE WHEN lower(trim(outcome_class)) IN ('error', 'rate_limited', 'blocked') THEN 1 ELSE 0 END) AS BIGINT) AS label FROM ev GROUP BY {KEYS}),
sc AS (SELECT {KEYS}, round(seq_raw, 9) AS score_markov, round(h, 9) AS score_entropy, n_events, label FROM b1 JOIN en USING ({KEYS}) JOIN lb USING ({KEYS})),
ra AS (SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY score_markov DESC, session_key, user_id) AS rank FROM sc),
rb AS (SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY score_entropy DESC, session_key, user_id) AS rank FROM sc)"""


def scores(spark, sf):
    ev = X.weekly_events(spark, sf)
    a = S.markov(ev).select(*SESSION_KEYS, "n_events", F.round("seq_raw", 9).alias("score_markov"))
    b = S.entropies(ev, SESSION_KEYS).select(*SESSION_KEYS, F.round("entropy_session", 9).alias("score_entropy"))
    return materialize(a.join(b, list(SESSION_KEYS)), "scores"), V.weak_labels(ev)


def ranked(s, col, k=K):
    return St.top_k(s, PARTITION_KEYS, [F.desc(col), F.asc("session_key"), F.asc("user_id")], k)


@query("weak_label", f"""WITH {SESSIONS} SELECT {KEYS}, CAST(max(CASE WHEN outcome_class IN ('error', 'rate_limited', 'blocked') THEN 1 ELSE 0 END) AS BIGINT) AS label,
  CAST(max(CASE WHEN outcome_class IN ('error', 'rate_limited', 'blocked') THEN 1 ELSE 0 END) AS BIGINT) AS label_array FROM ev GROUP BY {KEYS}""")
def weak_label(spark, sf):
    ev = X.session_events(spark, sf)
    arr = ev.groupBy(*SESSION_KEYS).agg(V.weak_label(F.collect_set(F.concat(F.lit(" "), F.upper("outcome_class")))).alias("label_array"))
    return V.weak_labels(ev).join(arr, list(SESSION_KEYS))




@query("precision_at_k", f"""WITH {SCORES}, lf AS (SELECT {KEYS}, label, 'score_markov' AS score_col, score_markov AS s FROM sc UNION ALL SELECT {KEYS}, label, 'score_entropy', score_entropy FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY score_col ORDER BY s DESC, {KEYS}) AS i, count(*) OVER (PARTITION BY score_col) AS n_scored, sum(label) OVER (PARTITION BY score_col) AS pos FROM lf),
ks(k) AS (VALUES (50), (100), (200), (500), (1000))
SELECT score_col, CAST(k AS BIGINT) AS k, n_scored, CAST(any_value(pos) AS BIGINT) AS n_pos_total, CAST(sum(label) FILTER (i <= k) AS BIGINT) AS hits, {r6('sum(label) FILTER (i <= k) / least(k, n_scored)')} AS precision_at_k
FROM rk, ks GROUP BY score_col, k, n_scored""")
def precision_at_k(spark, sf):
    s, labels = scores(spark, sf)
    return V.precision_at_k(s, labels, ["score_markov", "score_entropy"])


@query("precision_by_client", f"""WITH {SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY client_name ORDER BY score_markov DESC, {KEYS}) AS i, count(*) OVER (PARTITION BY client_name) AS n_scored FROM sc),
ks(k) AS (VALUES (10), (100))
SELECT client_name, CAST(k AS BIGINT) AS k, {r6('sum(label) FILTER (i <= k) / least(k, n_scored)')} AS precision_at_k FROM rk, ks GROUP BY client_name, k, n_scored""")
def precision_by_client(spark, sf):
    s, labels = scores(spark, sf)
    return V.precision_at_k(s, labels, ["score_markov"], (10, 100), part=("client_name",)).select("client_name", "k", "precision_at_k")


@query("overlap", f"""WITH {SCORES}, a AS (SELECT {KEYS} FROM ra WHERE rank <= {K}), b AS (SELECT {KEYS} FROM rb WHERE rank <= {K}),
i AS (SELECT {PART}, count(*) AS common FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY ALL), u AS (SELECT {PART}, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY ALL)
SELECT {PART}, coalesce(common, 0) AS common, {r6(f'coalesce(common, 0) / {K}')} AS overlap, {r6('coalesce(common, 0) / n')} AS jaccard FROM u LEFT JOIN i USING (client_name, day)""")
def overlap(spark, sf):
    s, _ = scores(spark, sf)
    return V.overlap(ranked(s, "score_markov"), ranked(s, "score_entropy"), K, part=PARTITION_KEYS)


@query("topk_sets", f"""WITH {SCORES}, a AS (SELECT {KEYS} FROM ra WHERE rank <= {K}), b AS (SELECT {KEYS} FROM rb WHERE rank <= {K})
SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def topk_sets(spark, sf):
    s, _ = scores(spark, sf)
    a, b = (materialize(ranked(s, c).select(*SESSION_KEYS), "top") for c in ("score_markov", "score_entropy"))
    n = F.count("*").alias("n")
    # Counted without groups, so that an empty set has its row.
    return a.intersect(b).agg(n).select(F.lit("intersect").alias("op"), "n").unionByName(
        a.union(b).distinct().agg(n).select(F.lit("union").alias("op"), "n"))


@query("jaccard", f"""WITH {SCORES}, a AS (SELECT {KEYS} FROM sc ORDER BY score_markov DESC, {KEYS} LIMIT 200), b AS (SELECT {KEYS} FROM sc ORDER BY score_entropy DESC, {KEYS} LIMIT 200)
SELECT count(*) AS common, {r6('count(*) / 200')} AS overlap, {r6('count(*) / (400 - count(*))')} AS jaccard FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def jaccard(spark, sf):
    s, _ = scores(spark, sf)
    a, b = (s.orderBy(F.desc(c), *SESSION_KEYS).limit(200) for c in ("score_markov", "score_entropy"))
    return V.overlap(a, b, 200)


# Review labels: documents stand in for sessions, their languages for partitions, their length for the score.
REVIEW = """rv AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
l1 AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'suspicious' WHEN quality = 0 THEN 'needs_review' ELSE 'normal' END AS label FROM labels),
l2 AS (SELECT doc_id, CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN 'benign_fp' WHEN toxic = 1 THEN 'suspicious' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'normal' WHEN quality = 0 THEN 'needs_review' ELSE 'normal' END AS label FROM labels)"""


def reviews(spark, sf):
    docs = X.read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    top = St.top_k(docs, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 100)
    lab, i = X.read(spark, sf, "labels"), F.col("doc_id")
    tox, low = F.col("toxic") == 1, F.col("quality") == 0
    one = lab.select("doc_id", F.when(tox, "suspicious").when(low, "needs_review").otherwise("normal").alias("label"))
    two = lab.select("doc_id", F.when(tox & (i % 3 == 0), "benign_fp").when(tox, "suspicious").when(low & (i % 2 == 0), "normal")
                     .when(low, "needs_review").otherwise("normal").alias("label"))
    return top, one, two


@query("precision_relaxed", f"""WITH {REVIEW} SELECT lang, round(sum(CASE WHEN label IN ('suspicious', 'needs_review') THEN 1 ELSE 0 END) / 100, 6) + 0.0 AS precision_at_k_relaxed, count(label) AS reviewed
FROM rv LEFT JOIN l1 USING (doc_id) WHERE rank <= 100 GROUP BY lang""")
def precision_relaxed(spark, sf):
    top, one, _ = reviews(spark, sf)
    return V.relaxed_precision(top, one, 100, ["doc_id"], ["lang"])


@query("consistency", f"""WITH {REVIEW} SELECT lang, round(sum(CASE WHEN l1.label = l2.label THEN 1 ELSE 0 END) / 100, 6) + 0.0 AS consistency_at_k
FROM rv JOIN l1 USING (doc_id) JOIN l2 USING (doc_id) WHERE rank <= 100 GROUP BY lang""")
def consistency(spark, sf):
    top, one, two = reviews(spark, sf)
    return V.consistency(top.join(one, "doc_id"), two, 100, ["doc_id"], ["lang"])


@query("drift", f"""WITH {SCORES}, d AS (SELECT {PART}, avg(score_markov) AS mean, stddev_pop(score_markov) AS std, quantile_cont(score_markov, 0.5) AS p50, quantile_cont(score_markov, 0.95) AS p95, count(*) AS n_values FROM sc GROUP BY ALL)
SELECT {PART}, n_values, {r6('mean')} AS mean, {r6('std')} AS std, {r6('p50')} AS p50, {r6('p95')} AS p95, {r6('mean - lag(mean) OVER w')} AS d_mean, {r6('std - lag(std) OVER w')} AS d_std,
  {r6('p50 - lag(p50) OVER w')} AS d_p50, {r6('p95 - lag(p95) OVER w')} AS d_p95 FROM d WINDOW w AS (PARTITION BY client_name ORDER BY day)""")
def drift(spark, sf):
    return V.drift(scores(spark, sf)[0], "score_markov", "day")


@query("topk_stability", f"""WITH {SCORES}, t AS (SELECT DISTINCT client_name, day, user_id FROM ra WHERE rank <= {K}),
n AS (SELECT client_name, day, lead(day) OVER (PARTITION BY client_name ORDER BY day) AS next_period FROM (SELECT DISTINCT client_name, day FROM t))
SELECT t.client_name, t.day, next_period, count(u.user_id) AS common, {r6(f'count(u.user_id) / {K}')} AS stability FROM t JOIN n USING (client_name, day)
LEFT JOIN t u ON u.client_name = t.client_name AND u.day = next_period AND u.user_id = t.user_id WHERE next_period IS NOT NULL GROUP BY ALL""")
def topk_stability(spark, sf):
    return V.stability(ranked(scores(spark, sf)[0], "score_markov"), "day", K)


@query("gain", f"""WITH {SCORES}, ks(k) AS (VALUES (50), (200)),
p AS (SELECT k, sum(label) FILTER (i <= k) / k AS base, sum(label) FILTER (j <= k) / k AS other FROM (SELECT label, row_number() OVER (ORDER BY score_markov DESC, {KEYS}) AS i,
  row_number() OVER (ORDER BY score_entropy DESC, {KEYS}) AS j FROM sc), ks GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, {r6('base')} AS base, {r6('other')} AS other, {r6('other - base')} AS gain FROM p""")
def gain(spark, sf):
    s, labels = scores(spark, sf)
    p = V.precision_at_k(s, labels, ["score_markov", "score_entropy"], (50, 200))
    return V.gain(p.where(F.col("score_col") == "score_markov"), p.where(F.col("score_col") == "score_entropy"))


@query("seed_sensitivity")
def seed_sensitivity(spark, sf):
    f = materialize(weekly_features(spark, sf), "features")
    labels = V.weak_labels(X.weekly_events(spark, sf))
    tops, precisions = [], []
    for seed in (1, 2, 3):
        r = rank_by_forest(f, ("day",), SESSION_KEYS, replace(IMPL, trees=50, seed=seed))
        r = materialize(r.select(*SESSION_KEYS, "if_raw"), "scores")
        tag = [F.lit("forest").alias("model"), F.lit(seed).alias("seed")]
        tops.append(r.orderBy(F.desc("if_raw"), *SESSION_KEYS).limit(50).select(*tag, *SESSION_KEYS))
        precisions.append(V.precision_at_k(r, labels, ["if_raw"], (50,)).select(*tag, "k", "precision_at_k"))
    union = readers.union_relaxed
    return V.seed_sensitivity(union(tops), union(precisions))


@query("report", f"""WITH {SCORES}, ks(k) AS (VALUES (50), (200))
SELECT 'precision_at_k' AS metric, '{{"score_col":"score_markov","k":' || k || '}}' AS detail, {r6('sum(label) FILTER (i <= k) / k')} AS value FROM (SELECT label, row_number() OVER (ORDER BY score_markov DESC, {KEYS}) AS i FROM sc), ks GROUP BY k
UNION ALL SELECT 'sessions', '{{"client_name":"' || client_name || '"}}', count(*) + 0.0::DOUBLE FROM sc GROUP BY client_name""")
def report(spark, sf):
    s, labels = scores(spark, sf)
    p = V.precision_at_k(s, labels, ["score_markov"], (50, 200)).select("score_col", "k", "precision_at_k")
    return V.report({"precision_at_k": p, "sessions": s.groupBy("client_name").agg(F.count("*").alias("n"))})


@query("costs")
def costs(spark, sf):
    ev, rows = X.weekly_events(spark, sf), []
    for name, model in S.MODELS.items():
        t0, seen = time.time(), F.count(F.lit(1)).alias("rows")
        n = model(ev).agg(seen).first()["rows"]
        rows.append(("events", name, time.time() - t0, n))
    return V.costs(spark.createDataFrame(rows, "dataset string, model string, seconds double, rows bigint"))


@query("union_by_name", """SELECT CAST(o_orderkey AS DOUBLE) AS key, CAST(o_custkey AS VARCHAR) AS party, o_orderstatus AS status, NULL AS balance FROM orders
UNION ALL SELECT CAST(c_custkey AS DOUBLE), c_name, NULL, c_acctbal FROM customer""")
def union_by_name(spark, sf):
    o = X.read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("party"), F.col("o_orderstatus").alias("status"))
    c = X.read(spark, sf, "customer").select(F.col("c_custkey").cast("double").alias("key"), F.col("c_name").alias("party"), F.col("c_acctbal").alias("balance"))
    return readers.union_relaxed([o, c])


@query("pruned_read", """SELECT l_orderkey, l_partkey FROM lineitem""")
def pruned_read(spark, sf):
    return readers.read_tables(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey"])


@query("export_by_day", f"""WITH {SESSIONS} SELECT {KEYS}, {ts('min(event_time)')} AS session_start, {ts('max(event_time)')} AS session_end, count(*) AS n_events FROM ev GROUP BY {KEYS}""")
def export_by_day(spark, sf):
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    writers.write_sessions(Z.rollup(X.session_events(spark, sf)), path)
    return readers.read_tables(spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("export_texts", f"""WITH {WEEKLY}, c AS (SELECT {KEYS}, count(*) AS n FROM ev GROUP BY {KEYS})
SELECT 'csv' AS format, * FROM c UNION ALL SELECT 'json', * FROM c UNION ALL SELECT 'client', * FROM c""")
def export_texts(spark, sf):
    base = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    df = X.weekly_events(spark, sf).groupBy(*SESSION_KEYS).agg(F.count("*").alias("n"))
    writers.write_table(df, f"{base}-csv", "csv")
    writers.write_table(df, f"{base}-json", "json")
    writers.write_token_table(df.withColumn("version", F.lit("v0")), f"{base}-client")
    back = [("csv", spark.read.schema(df.schema).option("header", "true").csv(f"{base}-csv")),
            ("json", spark.read.schema(df.schema).json(f"{base}-json")), ("client", readers.read_tables(spark, f"{base}-client"))]
    parts = [d.select(F.lit(name).alias("format"), *df.columns) for name, d in back]
    return readers.union_relaxed(parts)


@query("fingerprint")
def fingerprint(spark, sf):
    parts = [writers.fingerprint(X.read(spark, sf, t)).select(F.lit(t).alias("table"), "*") for t in ("events", "orders", "customer")]
    return readers.union_relaxed(parts)


@query("schema_manifest")
def schema_manifest(spark, sf):
    ev = X.session_events(spark, sf)
    filled = ev.agg(*[F.count(c).alias(c) for c in ev.columns]).unpivot([], ev.columns, "column", "filled_rows")
    return writers.schema_manifest(ev, {"token": "client, operation, outcome, gap"}).join(filled, "column")


@query("run_metadata")
def run_metadata(spark, sf):
    from pyspark.sql import Observation
    t0, seen = time.time(), Observation()
    out = X.session_events(spark, sf).observe(seen, F.count(F.lit(1)).alias("rows"))
    materialize(Z.rollup(out), "rollup")
    return writers.run_metadata(spark, "sessions", {"gap_minutes": X.GAP_MINUTES}, {"events": seen.get["rows"]},
                                {"rollup": time.time() - t0}, {"time_unreliable": "duration and peak are 0"}).drop("generated_at")

"""Queries: sequence scores and their drilldowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as S
from ..operators import stats as St
from ..schema import PARTITION_KEYS, SESSION_KEYS
from ..staging import materialize
from . import fixtures as X
from .registry import query, r6
from .sql_base import KEYS, WEEKLY

PART = "client_name, day"

STEPS = f"""{WEEKLY},
step AS (
  SELECT *, lag(token) OVER s AS prev_token, lead(token) OVER s AS next_token, lead(token, 2) OVER s AS third_token
  FROM ev WINDOW s AS (PARTITION BY {KEYS} ORDER BY seq_no)
),
c_ab AS (SELECT {PART}, token, next_token, count(*) AS c_ab FROM step WHERE next_token IS NOT NULL GROUP BY ALL),
c_a AS (SELECT {PART}, token, count(next_token) AS c_a FROM step GROUP BY ALL),
voc AS (SELECT {PART}, count(DISTINCT token) AS v FROM step GROUP BY ALL)"""

B1 = f"""{STEPS},
b1 AS (
  SELECT {KEYS}, coalesce({{reduce}}(-ln((c_ab + 1) / (c_a + v))), 0) AS seq_raw, count(*) AS n_events,
    count(next_token) AS n_transitions
  FROM step LEFT JOIN c_ab USING (client_name, day, token, next_token)
    LEFT JOIN c_a USING (client_name, day, token) JOIN voc USING (client_name, day) GROUP BY {KEYS}
)"""
B1_MEAN = B1.replace("{reduce}", "avg")
B1_SUM = B1.replace("{reduce}", "sum")

GRAMS = f"""{STEPS},
gram AS (
  SELECT {KEYS}, 2 AS n, token || '|' || next_token AS ngram FROM step WHERE next_token IS NOT NULL
  UNION ALL
  SELECT {KEYS}, 3, token || '|' || next_token || '|' || third_token FROM step WHERE third_token IS NOT NULL
),
gc AS (SELECT {PART}, n, ngram, count(*) AS c_all FROM gram GROUP BY ALL),
gt AS (SELECT {PART}, sum(c_all) + count(*) AS denom FROM gc GROUP BY ALL),
gs AS (SELECT gram.*, c_all, -ln((c_all + 1) / denom) AS nll
  FROM gram JOIN gc USING (client_name, day, n, ngram) JOIN gt USING (client_name, day))"""

B2 = f"""{GRAMS},
b2 AS (
  SELECT e.*, coalesce(s.seq_raw, 0) AS seq_raw, coalesce(s.n_ngrams, 0) AS n_ngrams
  FROM (SELECT {KEYS}, count(*) AS n_events FROM ev GROUP BY {KEYS}) e
  LEFT JOIN (SELECT {KEYS}, {{reduce}}(nll) AS seq_raw, count(*) AS n_ngrams FROM gs GROUP BY {KEYS}) s USING ({KEYS})
)"""

B3 = f"""{WEEKLY},
tc AS (SELECT {KEYS}, token, count(*) AS c FROM ev GROUP BY ALL),
en AS (SELECT {KEYS}, sum(c) AS n_events, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM tc GROUP BY {KEYS}),
b3 AS (SELECT *, greatest(h, 0) AS entropy_session,
  quantile_cont(greatest(h, 0), 0.5) OVER (PARTITION BY {PART}) AS entropy_median_partition FROM en)"""


def scaled(cte: str, flat: str) -> str:
    """Risk 0-100 of `seq_raw` of a CTE between p50 and p95 of its partition."""
    instead = "0" if flat == "zero" else "CASE WHEN hi > lo THEN (seq_raw - lo) / (hi - lo) * 100 ELSE 0 END"
    return f"""fx AS (SELECT * REPLACE (round(seq_raw, 9) AS seq_raw) FROM {cte}),
sc AS (SELECT *, greatest(0, least(100,
      CASE WHEN p95 > p50 THEN (seq_raw - p50) / (p95 - p50) * 100 ELSE {instead} END)) AS risk_score_seq
  FROM fx JOIN (SELECT {PART}, quantile_cont(seq_raw, 0.5) AS p50, quantile_cont(seq_raw, 0.95) AS p95,
    min(seq_raw) AS lo, max(seq_raw) AS hi FROM fx GROUP BY {PART}) q USING ({PART}))"""


@query("b1_markov", f"""WITH {B1_MEAN}, {scaled('b1', 'minmax')}
SELECT {KEYS}, {r6('seq_raw')} AS seq_raw, n_events, n_transitions, {r6('risk_score_seq')} AS risk_score_seq, 'b1' AS model FROM sc""")
def b1_markov(spark, sf):
    return S.with_risk(S.markov(X.weekly_events(spark, sf)))


@query("b1_markov_sum", f"""WITH {B1_SUM}, {scaled('b1', 'zero')}
SELECT {KEYS}, {r6('seq_raw')} AS seq_raw, n_events, n_transitions, {r6('risk_score_seq')} AS risk_score_seq, 'b1' AS model FROM sc""")
def b1_markov_sum(spark, sf):
    return S.with_risk(S.markov(X.weekly_events(spark, sf), reduce="sum"), flat="zero")


@query("b2_ngram", f"""WITH {B2.replace('{reduce}', 'avg')}, {scaled('b2', 'minmax')}
SELECT {KEYS}, {r6('seq_raw')} AS seq_raw, n_events, n_ngrams, {r6('risk_score_seq')} AS risk_score_seq, 'b2' AS model FROM sc""")
def b2_ngram(spark, sf):
    return S.with_risk(S.ngram_rarity(X.weekly_events(spark, sf)))


@query("b2_ngram_sum", f"""WITH {B2.replace('{reduce}', 'sum')}
SELECT {KEYS}, {r6('seq_raw')} AS seq_raw, n_events, n_ngrams, 'b2' AS model FROM b2""")
def b2_ngram_sum(spark, sf):
    return S.ngram_rarity(X.weekly_events(spark, sf), reduce="sum")


@query("b3_entropy", f"""WITH {B3}, b3r AS (SELECT *, abs(entropy_session - entropy_median_partition) AS seq_raw FROM b3),
{scaled('b3r', 'minmax')}
SELECT {KEYS}, n_events, {r6('entropy_session')} AS entropy_session, {r6('entropy_median_partition')} AS entropy_median_partition,
  {r6('seq_raw')} AS seq_raw, {r6('risk_score_seq')} AS risk_score_seq, 'b3' AS model FROM sc""")
def b3_entropy(spark, sf):
    return S.with_risk(S.entropy_deviation(X.weekly_events(spark, sf)))


@query("b_composite", f"""WITH {WEEKLY},
step AS (SELECT *, lead(route_group) OVER (PARTITION BY {KEYS} ORDER BY seq_no) AS nxt FROM ev),
c_ab AS (SELECT {PART}, route_group, nxt, count(*) AS c_ab FROM step WHERE nxt IS NOT NULL GROUP BY ALL),
c_a AS (SELECT {PART}, route_group, sum(c_ab) AS c_a FROM c_ab GROUP BY ALL),
tot AS (SELECT {PART}, sum(c_ab) AS total FROM c_ab GROUP BY ALL),
voc AS (SELECT {PART}, count(DISTINCT t) AS v FROM (SELECT {PART}, route_group AS t FROM c_ab UNION ALL SELECT {PART}, nxt FROM c_ab) GROUP BY ALL),
sq AS (SELECT {KEYS}, coalesce(avg(-ln((c_ab + 0.5::DOUBLE) / (c_a + 0.5::DOUBLE * v) + 1e-9)), 0) AS b1_mnll,
    coalesce(avg(-ln((c_ab + 1) / (total + v * v) + 1e-9)), 0) AS b2_score
  FROM step LEFT JOIN c_ab USING (client_name, day, route_group, nxt) LEFT JOIN c_a USING (client_name, day, route_group)
    LEFT JOIN tot USING (client_name, day) LEFT JOIN voc USING (client_name, day) GROUP BY {KEYS}),
rc AS (SELECT {KEYS}, route_group, count(*) AS c FROM ev GROUP BY ALL),
en AS (SELECT {KEYS}, -sum(p * ln(p + 1e-9)) AS b3_entropy
  FROM (SELECT *, c / sum(c) OVER (PARTITION BY {KEYS}) AS p FROM rc) GROUP BY {KEYS}),
a AS (SELECT {KEYS}, round(b1_mnll, 9) AS b1_mnll, round(b2_score, 9) AS b2_score, round(b3_entropy, 9) AS b3_entropy
  FROM sq JOIN en USING ({KEYS})),
m AS (SELECT {PART}, quantile_cont(b1_mnll, 0.5) AS m1, quantile_cont(b2_score, 0.5) AS m2, quantile_cont(b3_entropy, 0.5) AS m3 FROM a GROUP BY ALL),
d AS (SELECT {PART}, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, quantile_cont(abs(b1_mnll - m1), 0.5) AS d1,
  quantile_cont(abs(b2_score - m2), 0.5) AS d2, quantile_cont(abs(b3_entropy - m3), 0.5) AS d3 FROM a JOIN m USING (client_name, day) GROUP BY ALL),
z AS (SELECT a.*, (b1_mnll - m1) / (1.4826::DOUBLE * (d1 + 1e-9)) AS b1_z, (b2_score - m2) / (1.4826::DOUBLE * (d2 + 1e-9)) AS b2_z,
  abs((b3_entropy - m3) / (1.4826::DOUBLE * (d3 + 1e-9))) AS b3_z FROM a JOIN d USING (client_name, day))
SELECT {KEYS}, {r6('b1_mnll')} AS b1_mnll, {r6('b2_score')} AS b2_score, {r6('b3_entropy')} AS b3_entropy, round(b1_z, 3) + 0.0 AS b1_z,
  round(b2_z, 3) + 0.0 AS b2_z, round(b3_z, 3) + 0.0 AS b3_z, round(greatest(b1_z, 0) + greatest(b2_z, 0) + b3_z, 3) + 0.0 AS b_risk FROM z""")
def b_composite(spark, sf):
    return S.composite(X.weekly_events(spark, sf)).withColumns(
        {c: F.round(c, 3) for c in ("b1_z", "b2_z", "b3_z", "b_risk")})


@query("transition_counts", f"""WITH {STEPS}
SELECT {PART}, token AS a, next_token AS b, c_ab, c_a, v FROM c_ab JOIN c_a USING (client_name, day, token) JOIN voc USING (client_name, day)""")
def transition_counts(spark, sf):
    steps = S.session_steps(X.weekly_events(spark, sf), SESSION_KEYS, "token")
    c = S.transition_counts(steps, PARTITION_KEYS)
    c_a = c.groupBy(*PARTITION_KEYS, "a").agg(F.sum("c_ab").alias("c_a"))
    return c.join(c_a, [*PARTITION_KEYS, "a"]).join(S.partition_vocabulary(steps, PARTITION_KEYS), list(PARTITION_KEYS))


@query("ngram_counts", f"""WITH {GRAMS}
SELECT {PART}, n, ngram, c_all FROM gc""")
def ngram_counts(spark, sf):
    grams = S.session_ngrams(X.weekly_events(spark, sf), SESSION_KEYS, "token")
    return grams.groupBy(*PARTITION_KEYS, "n", F.concat_ws("|", "t1", "t2", "t3").alias("ngram")).agg(F.sum("c").alias("c_all"))


@query("order_entropy", """WITH tc AS (
  SELECT o_orderstatus AS client_name, l_orderkey AS session_key, l_returnflag || ':' || l_linestatus AS token, count(*) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
h AS (SELECT client_name, session_key, sum(c) AS n_events, greatest(ln(sum(c)) - sum(c * ln(c)) / sum(c), 0) AS h FROM tc GROUP BY ALL)
SELECT client_name, session_key, CAST(n_events AS BIGINT) AS n_events, round(h, 6) + 0.0 AS entropy_session,
  round(quantile_cont(h, 0.5) OVER (PARTITION BY client_name), 6) + 0.0 AS entropy_median_partition,
  round(abs(h - quantile_cont(h, 0.5) OVER (PARTITION BY client_name)), 6) + 0.0 AS seq_raw, 'b3' AS model FROM h""")
def order_entropy(spark, sf):
    ev = X.read(spark, sf, "lineitem").join(X.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderstatus").alias("client_name"), F.col("l_orderkey").alias("session_key"),
        F.concat("l_returnflag", F.lit(":"), "l_linestatus").alias("token"))
    return S.entropy_deviation(ev, ("client_name", "session_key"), ("client_name",))


@query("b_scale", """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.95) AS p95,
  quantile_cont(c_acctbal, 0.01) AS p1, quantile_cont(c_acctbal, 0.99) AS p99 FROM customer GROUP BY ALL)
SELECT c_custkey, round(greatest(0, least(100, (c_acctbal - p50) / (p95 - p50) * 100)), 6) + 0.0 AS risk_seq,
  round(greatest(0, least(100, (c_acctbal - p1) / (p99 - p1) * 100)), 6) + 0.0 AS risk_wide FROM customer JOIN q USING (c_mktsegment)""")
def b_scale(spark, sf):
    c = X.read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    one = St.scale_0_100(c, ["c_mktsegment"], "c_acctbal", "risk_seq", 0.50, 0.95)
    return St.scale_0_100(one, ["c_mktsegment"], "c_acctbal", "risk_wide", 0.01, 0.99).select("c_custkey", "risk_seq", "risk_wide")


@query("topk_part", f"""WITH {B1_MEAN}, r AS (
  SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY round(seq_raw, 9) DESC, session_key, user_id) AS rank FROM b1)
SELECT {KEYS}, rank, {r6('seq_raw')} AS seq_raw FROM r WHERE rank <= 20""")
def topk_part(spark, sf):
    scores = S.markov(X.weekly_events(spark, sf)).withColumn("seq_raw", F.round("seq_raw", 9))
    return S.rank_sequences(scores, k=20).select(*SESSION_KEYS, "rank", "seq_raw")


@query("top_sequences", f"""WITH {B1_MEAN}, {scaled('b1', 'minmax')}
SELECT {KEYS}, {r6('risk_score_seq')} AS risk_score_seq, {r6('seq_raw')} AS seq_raw, n_events FROM sc
ORDER BY round(sc.risk_score_seq, 6) DESC, round(sc.seq_raw, 6) DESC, {KEYS} LIMIT 200""")
def top_sequences(spark, sf):
    s = b1_markov(spark, sf).withColumns({c: F.round(c, 6) for c in ("risk_score_seq", "seq_raw")})
    return S.top_sequences(s).select(*SESSION_KEYS, "risk_score_seq", "seq_raw", "n_events")


WANTED = f"""want AS (SELECT {KEYS} FROM ev GROUP BY {KEYS} ORDER BY count(*) DESC, {KEYS} LIMIT 50)"""


def wanted(ev):
    """The 50 longest sessions."""
    return ev.groupBy(*SESSION_KEYS).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *SESSION_KEYS).limit(50)


@query("prev_next_token", f"""WITH {STEPS}, {WANTED}
SELECT {KEYS}, seq_no, step.token, prev_token, step.next_token, c_ab AS transition_count
FROM step JOIN want USING ({KEYS}) LEFT JOIN c_ab USING (client_name, day, token, next_token)""")
def prev_next_token(spark, sf):
    ev = X.weekly_events(spark, sf)
    counts = S.transition_counts(S.session_steps(ev, SESSION_KEYS, "token"), PARTITION_KEYS)
    return S.drill_steps(ev, wanted(ev), counts=counts).select(
        *SESSION_KEYS, "seq_no", "token", "prev_token", "next_token", "transition_count")


@query("rare_ngrams", f"""WITH {GRAMS}, {WANTED},
per AS (SELECT {KEYS}, n, ngram, count(*) AS c, any_value(nll) AS nll FROM gs JOIN want USING ({KEYS}) GROUP BY {KEYS}, n, ngram),
r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY nll DESC, n, ngram) AS rarity_rank FROM per)
SELECT {KEYS}, n, ngram, c, {r6('nll')} AS nll, rarity_rank FROM r WHERE rarity_rank <= 10""")
def rare_ngrams(spark, sf):
    ev = X.weekly_events(spark, sf)
    return S.drill_ngrams(S.session_ngrams(ev, SESSION_KEYS, "token"), wanted(ev))


@query("top_tokens", f"""WITH {B3}, {WANTED},
r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY c DESC, token) AS i FROM tc JOIN want USING ({KEYS}))
SELECT {KEYS}, string_agg(token || '(' || c || ')', ', ' ORDER BY i) AS top_tokens,
  {r6('any_value(entropy_session)')} AS entropy_session, {r6('any_value(entropy_median_partition)')} AS entropy_median_partition
FROM r JOIN b3 USING ({KEYS}) WHERE i <= 10 GROUP BY {KEYS}""")
def top_tokens(spark, sf):
    ev = X.weekly_events(spark, sf)
    return S.drill_entropy(ev, S.entropy_deviation(ev), wanted(ev))


@query("sequence_report", f"""WITH {B1_SUM}, {scaled('b1', 'zero')}, r AS (
  SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY round(seq_raw, 9) DESC, session_key, user_id) AS rank FROM sc)
SELECT {KEYS}, rank, {r6('seq_raw')} AS seq_raw, {r6('risk_score_seq')} AS risk_score_seq, n_events, 'B1' AS model_type,
  CASE WHEN risk_score_seq >= 100 THEN 'RARE_TRANSITIONS' WHEN risk_score_seq > 0 THEN 'UNUSUAL_TRANSITIONS' ELSE 'TYPICAL' END AS primary_reason_code
FROM r WHERE rank <= 200""")
def sequence_report(spark, sf):
    s = S.with_risk(S.markov(X.weekly_events(spark, sf), reduce="sum"), flat="zero")
    return S.sequence_summary(s.withColumn("seq_raw", F.round("seq_raw", 9)), "b1")

"""Queries: feature hygiene, robust statistics, forest, neighbours, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drilldown as D
from ..operators import explain as E
from ..operators import risk as R
from ..operators import sessionize as Z
from ..operators import stats as St
from ..operators.forest import rank_by_forest
from ..operators.neighbours import lof
from ..profiles import SPEC
from ..schema import SESSION_KEYS
from ..staging import materialize
from . import feature_ranking as A
from . import fixtures as X
from .q_drilldown import DRILL, RULE_END, W, longest, spec_events
from .q_sessions import FEATURES as FEATURES_SQL
from .registry import query, r6
from .sql_base import KEYS, SESSIONS, WEEKLY

# Features that show every branch of the explanation: rare ones, steady ones, and spread ones.
SHOWN = ("n_events", "n_error", "n_auth_fail", "n_rate_limited", "error_ratio", "n_chat", "n_t_start", "n_unique_tokens", "unique_token_ratio")


def weekly_features(spark, sf):
    return Z.session_features(X.weekly_events(spark, sf))


def _long_sql(cols) -> str:
    return " UNION ALL ".join(f"SELECT {KEYS}, {i} AS i, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for i, c in enumerate(cols))


STATS = f"""lf AS ({_long_sql(SHOWN)}),
md AS (SELECT day, feature, quantile_cont(value, 0.5) AS med FROM lf GROUP BY ALL),
mm AS (SELECT day, feature, any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad FROM lf JOIN md USING (day, feature) GROUP BY ALL),
dv0 AS (SELECT *, CASE WHEN mad <> 0 THEN (value - med) / mad END AS z FROM lf JOIN mm USING (day, feature))"""


@query("feature_stats", f"""WITH {WEEKLY}, {FEATURES_SQL}, {STATS} SELECT day, feature, {r6('med')} AS med, {r6('mad')} AS mad FROM mm""")
def feature_stats(spark, sf):
    return St.feature_stats(materialize(weekly_features(spark, sf)), ["day"], SHOWN)


@query("deviations", f"""WITH {WEEKLY}, {FEATURES_SQL}, {STATS} SELECT {KEYS}, feature, {r6('value')} AS value, {r6('med')} AS med, {r6('mad')} AS mad, {r6('z')} AS z FROM dv0""")
def deviations(spark, sf):
    return E.deviations(materialize(weekly_features(spark, sf)), ["day"], SESSION_KEYS, SHOWN)


@query("robust_z", f"""WITH {WEEKLY}, {FEATURES_SQL}, {STATS}
SELECT {KEYS}, {r6('max(az)')} AS z_max, round(avg(az), 3) AS z_mean FROM (SELECT *, abs(value - med) / CASE WHEN mad = 0 THEN 1e-9::DOUBLE ELSE mad END AS az FROM dv0) GROUP BY {KEYS}""")
def robust_z(spark, sf):
    z = E.robust_z_score(materialize(weekly_features(spark, sf)), ["day"], SESSION_KEYS, SHOWN)
    return z.withColumn("z_mean", F.round("z_mean", 3))


@query("why_top5", f"""WITH {WEEKLY}, {FEATURES_SQL}, {STATS},
w AS (SELECT *, med = 0 AND mad = 0 AND value <> 0 AS rare FROM dv0),
r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY rare DESC, CASE WHEN rare THEN 0 ELSE -abs(coalesce(z, 0)) END, i) AS p FROM w)
SELECT {KEYS}, string_agg(feature || '=' || printf('%.2f', value) || CASE WHEN rare THEN ' (rare_nonzero)' WHEN z IS NULL THEN ' (med=' || printf('%.2f', med) || ')'
  ELSE ' (med=' || printf('%.2f', med) || ', z=' || printf('%+.2f', z) || ')' END, '; ' ORDER BY p) AS why_top5 FROM r WHERE p <= 5 GROUP BY {KEYS}""")
def why_top5(spark, sf):
    return E.why_top(materialize(weekly_features(spark, sf)), ["day"], SHOWN).select(*SESSION_KEYS, "why_top5")


@query("robust_scale", """WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS qm, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qi,
  quantile_cont(l_extendedprice, 0.5) AS em, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS ei FROM lineitem GROUP BY ALL)
SELECT l_returnflag, feature, count(*) AS n, round(min(s), 6) + 0.0 AS least, round(max(s), 6) + 0.0 AS most FROM (
  SELECT l_returnflag, 'l_quantity' AS feature, (l_quantity - qm) / qi AS s FROM lineitem JOIN q USING (l_returnflag)
  UNION ALL SELECT l_returnflag, 'l_extendedprice', (l_extendedprice - em) / ei FROM lineitem JOIN q USING (l_returnflag)) GROUP BY ALL""")
def robust_scale(spark, sf):
    li = X.read(spark, sf, "lineitem")
    return St.robust_scale(li, ["l_returnflag"], ["l_quantity", "l_extendedprice"], []).groupBy("l_returnflag", "feature").agg(
        F.count("*").alias("n"), F.min("scaled").alias("least"), F.max("scaled").alias("most"))


@query("quantiles", """SELECT l_suppkey, count(*) AS n_values, round(quantile_cont(l_extendedprice, 0.01), 6) + 0.0 AS p1, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) + 0.0 AS p95, max(l_extendedprice) + 0.0 AS top FROM lineitem GROUP BY ALL""")
def quantiles(spark, sf):
    return St.quantiles(X.read(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p1": 0.01, "p50": 0.5, "p95": 0.95, "top": 1.0})


@query("pct_rank", """WITH c AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round((rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2)
  / count(*) OVER (PARTITION BY l_returnflag) * 100, 6) + 0.0 AS risk_pct FROM c""")
def pct_rank(spark, sf):
    li = X.read(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return St.percent_rank(li, ["l_returnflag"], "l_quantity", "risk_pct").drop("l_returnflag")


@query("hygiene", """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE
    WHEN event_id % 17 = 0 THEN '-Infinity'::DOUBLE ELSE value END AS a, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS b FROM events),
m AS (SELECT event_type, max(a) FILTER (isfinite(a)) AS top FROM e GROUP BY ALL)
SELECT event_id, round(CASE WHEN a IS NULL OR isnan(a) THEN 0 WHEN isinf(a) AND a > 0 THEN top WHEN isinf(a) THEN 0 ELSE a END, 6) + 0.0 AS a, coalesce(TRY_CAST(b AS DOUBLE), 0) + 0.0 AS b FROM e JOIN m USING (event_type)""")
def hygiene(spark, sf):
    i = F.col("event_id")
    e = X.read(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("inf")).when(i % 17 == 0, float("-inf")).otherwise(F.col("value")).alias("a"),
        F.when(i % 5 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("b"))
    return St.hygiene(e, ["event_type"], ["a", "b"]).drop("event_type")


NEAR = ("n_events", "error_ratio", "n_unique_tokens", "events_per_s")


@query("outlier_factor", f"""WITH {WEEKLY}, {FEATURES_SQL},
lx AS (SELECT {KEYS}, feature, value FROM ({" UNION ALL ".join(f"SELECT {KEYS}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for c in NEAR)})),
qs AS (SELECT day, feature, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM lx GROUP BY ALL),
vx AS (SELECT {KEYS}, list((value - c) / CASE WHEN w > 0 THEN w ELSE 1 END ORDER BY list_position([{", ".join(f"'{c}'" for c in NEAR)}], feature)) AS x FROM lx JOIN qs USING (day, feature) GROUP BY ALL),
kx AS (SELECT *, client_name || '|' || user_id || '|' || session_key AS id FROM vx),
pr AS (SELECT a.day, a.id, b.id AS near, round(sqrt(list_sum(list_transform(range(1, {len(NEAR) + 1}), lambda i: (a.x[i] - b.x[i]) ** 2))), 9) AS dist FROM kx a JOIN kx b ON a.day = b.day AND a.id <> b.id),
ne AS (SELECT day, id, near, dist FROM (SELECT *, row_number() OVER (PARTITION BY day, id ORDER BY dist, near) AS i FROM pr) WHERE i <= 10),
kd AS (SELECT day, id, max(dist) AS far FROM ne GROUP BY ALL),
de AS (SELECT ne.day, ne.id, 1 / (avg(greatest(dist, far)) + 1e-10::DOUBLE) AS density FROM ne JOIN kd ON kd.day = ne.day AND kd.id = ne.near GROUP BY ALL),
lo AS (SELECT ne.day, ne.id, avg(t.density) / any_value(m.density) AS lof FROM ne JOIN de t ON t.day = ne.day AND t.id = ne.near JOIN de m ON m.day = ne.day AND m.id = ne.id GROUP BY ALL)
SELECT {KEYS}, round(ln(coalesce(lof, 1)), 4) + 0.0 AS ln_lof FROM kx LEFT JOIN lo USING (day, id)""")
def outlier_factor(spark, sf):
    """Keys are ordered as text in both engines; of the factor, whose densities of equal rows are near 1e10, the logarithm is shown."""
    f = weekly_features(spark, sf)
    f = f.withColumn("_key", F.concat_ws("|", "client_name", "user_id", "session_key"))
    return lof(f, ["day"], ["_key"], NEAR, k=10).select(*SESSION_KEYS, F.round(F.ln("lof"), 4).alias("ln_lof"))


@query("iforest")
def iforest(spark, sf):
    return A.score_features(weekly_features(spark, sf)).select(*SESSION_KEYS, "if_raw", "anomaly_score", "risk_score", "risk_pct")


@query("iforest_spec")
def iforest_spec(spark, sf):
    ev = spec_events(spark, sf).select(*SESSION_KEYS, "seq_no", "event_time", "route_group", "outcome")
    f = R.rule_features(ev, SESSION_KEYS, X.START, RULE_END, window_s=W)
    f = R.with_labels(R.with_tags(R.with_risk_v2(f.withColumn("week", F.date_trunc("week", F.col("t0")).cast("date").cast("string")))))
    s = rank_by_forest(f.drop("threshold_hits"), ("week",), SESSION_KEYS, SPEC)
    order = [F.desc("if_raw"), F.desc("risk_score_v2"), F.desc("n_events"), F.asc("session_key"), F.asc("user_id")]
    return St.top_k(s, ["week"], order, SPEC.top_k).select(
        "week", *SESSION_KEYS, "rank", "if_raw", "risk_score_if", "risk_score_v2", "risk_tags", "primary_reason_code", "label_suggested", "confidence",
        R.component_breakdown().alias("component_breakdown"))


@query("feature_summary")
def feature_summary(spark, sf):
    return A.summarize(A.score_features(weekly_features(spark, sf)), X.weekly_events(spark, sf), window_s=W)[0]


TAGGED = f"""{SESSIONS}, {DRILL},
du AS (SELECT {KEYS}, date_diff('second', first, last) AS duration_s FROM (SELECT {KEYS}, min(event_time) AS first, max(event_time) AS last FROM ev GROUP BY {KEYS})),
tg AS (SELECT dd.*, duration_s, dd1.error_rate_dd AS er, dd1.rate_limited_rate_dd AS rl, dd1.route_skew AS sk, dd1.burst_score AS bs FROM dd JOIN du USING ({KEYS}) JOIN dd1 USING ({KEYS}))"""


@query("ranked_tags", f"""WITH {TAGGED}
SELECT {KEYS}, concat_ws(',', CASE WHEN er >= 0.2 THEN 'ERROR_HEAVY' END, CASE WHEN rl >= 0.2 THEN 'RATE_LIMIT_HEAVY' END, CASE WHEN max_events_in_30s >= 20 THEN 'BURST' WHEN bs >= 0.05 THEN 'BURST_DENSE' END,
    CASE WHEN duration_s >= 1800 THEN 'LONG_DURATION' END, CASE WHEN n_tokens_dd >= 10 THEN 'TOKEN_DIVERSE' END, CASE WHEN sk >= 0.9 THEN 'ROUTE_SKEW' END) AS risk_tags,
  concat_ws(' | ', CASE WHEN er >= 0.2 THEN 'error_rate=' || printf('%.0f%%', er * 100) END, CASE WHEN rl >= 0.2 THEN 'rate_limited_rate=' || printf('%.0f%%', rl * 100) END,
    CASE WHEN max_events_in_30s >= 20 THEN 'burst_peak30s=' || peak_30s_events WHEN bs >= 0.05 THEN 'burst_score=' || printf('%.2f', bs) END,
    CASE WHEN duration_s >= 1800 THEN 'duration_s=' || duration_s END, CASE WHEN n_tokens_dd >= 10 THEN 'n_unique_tokens=' || n_tokens_dd END,
    CASE WHEN sk >= 0.9 THEN 'route_skew=' || printf('%.0f%%', sk * 100) END) AS why_ranked, timeline_1line FROM tg""")
def ranked_tags(spark, sf):
    ev = X.session_events(spark, sf)
    top = materialize(longest(ev), "top")
    f = Z.session_features(ev).select(*SESSION_KEYS, "duration_s")
    dd = D.drilldown(ev, top, window_s=W)
    return R.with_ranked_tags(D.with_details(top.join(f, list(SESSION_KEYS)), dd)).select(*SESSION_KEYS, "risk_tags", "why_ranked", "timeline_1line")


@query("ranked_summary", f"""WITH {TAGGED}, {FEATURES_SQL},
sc AS (SELECT *, CAST(n_events AS DOUBLE) AS x FROM feat), q AS (SELECT quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99, count(*) AS n FROM sc),
rk AS (SELECT {KEYS}, n_events, feat_d AS duration_s, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2) / n * 100 AS risk_pct, greatest(0, least(100, (x - p1) / (p99 - p1) * 100)) AS risk_score
  FROM (SELECT *, duration_s AS feat_d FROM sc), q)
SELECT {KEYS}, round(risk_pct, 6) + 0.0 AS risk_pct, round(risk_score, 6) + 0.0 AS risk_score, n_events, rk.duration_s, n_events_dd, n_tokens_dd, error_rate_dd, token_top3, route_skew_pct, top_error_route, timeline_1line
FROM rk JOIN tg USING ({KEYS})""")
def ranked_summary(spark, sf):
    """The whole way to the summary with the number of events as score, which makes it checkable."""
    ev = X.session_events(spark, sf)
    f = Z.session_features(ev).withColumn("x", F.col("n_events").cast("double")).withColumn("anomaly_score", F.col("x")).withColumn("scope", F.lit("all").substr(F.lit(1), F.length("user_id") + 3))
    f = materialize(f, "features")
    s = St.percent_rank(St.scale_0_100(f, ["scope"], "x", "risk_score", 0.01, 0.99, "rank"), ["scope"], "x", "risk_pct")
    summary, _ = A.summarize(s, ev, 100, ("scope",), W)
    return summary.select(*SESSION_KEYS, "risk_pct", "risk_score", "n_events", "duration_s", "n_events_dd", "n_tokens_dd", "error_rate_dd",
                          "token_top3", "route_skew_pct", "top_error_route", "timeline_1line")

"""Queries that show what can be checked of results SQL cannot compute: models, hashes, records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import learned as L
from ..operators import pack as P
from ..operators import risk as R
from ..operators import sequence as S
from ..operators import sessionize as Z
from ..operators import stats as St
from ..operators import tokens as K
from ..operators import drilldown as D
from ..operators.forest import rank_by_forest
from ..profiles import IMPL, SPEC
from ..schema import SESSION_KEYS
from ..sources import writers
from ..staging import join_scope, materialize
from . import feature_ranking as A
from . import fixtures as X
from . import spec_artifacts as Art
from .q_drilldown import DRILL, W, longest, rule_rows
from .q_ranking import weekly_features
from .q_sequences import B3, GRAMS, PART, scaled
from .q_sessions import FEATURES as FEATURES_SQL
from .registry import query, r6
from .sql_base import KEYS, SESSIONS, WEEKLY

PER_WEEK = f"""{FEATURES_SQL}, s AS (SELECT day, count(*) AS n FROM feat GROUP BY day)"""


def planted(df, by, features):
    """One more row per `by` whose features lie far beyond all others."""
    far = df.groupBy(*by).agg(*(F.max(c).alias(c) for c in features))
    far = far.select(*by, *((F.col(c).cast("double") * 50 + 1000).alias(c) for c in features))
    rest = [c for c in SESSION_KEYS if c not in by]
    return df.select(*SESSION_KEYS, *(F.col(c).cast("double").alias(c) for c in features)).unionByName(far.withColumns({c: F.lit("planted") for c in rest}))


def ranks_again(scored, part):
    """Windows over the written scores, against what the operators gave: rows, ranks that differ, scores out of range, whether the planted row is first."""
    w = Window.partitionBy(*part)
    again = (F.rank().over(w.orderBy("if_raw")) + (F.count("*").over(w.partitionBy(*part, "if_raw")) - 1) / 2) / F.count("*").over(w) * 100
    return scored.withColumns({"again": again, "first": F.rank().over(w.orderBy(F.desc("if_raw")))})


@query("iforest_checks", f"""WITH {WEEKLY}, {PER_WEEK} SELECT day, n + 1 AS n, 0 AS ranks_differ, 0 AS scores_differ, 0 AS out_of_range, 1 AS planted_first FROM s""")
def iforest_checks(spark, sf):
    """Percent ranks and scaled scores of the forest recomputed by windows from its raw scores, and a planted far row per week."""
    f = planted(materialize(weekly_features(spark, sf), "features"), ["day"], IMPL.features)
    scored = materialize(A.score_features(f), "scored")
    again = ranks_again(scored, ["day"])
    lo, hi = (F.expr(f"percentile(if_raw, {q})").over(Window.partitionBy("day")) for q in IMPL.scale)
    spread = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("if_raw") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100))
    again = again.withColumns({"lo": lo, "hi": hi}).withColumn("score", F.when(F.col("hi") - F.col("lo") > 1e-9, spread).otherwise(F.col("again")))
    return again.groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("again") - F.col("risk_pct")) > 1e-9).alias("ranks_differ"), F.count_if(F.abs(F.col("score") - F.col("risk_score")) > 1e-6).alias("scores_differ"),
        F.count_if(~F.col("if_raw").between(0, 1)).alias("out_of_range"), F.max(F.when((F.col("session_key") == "planted") & (F.col("first") == 1), 1).otherwise(0)).alias("planted_first"))


@query("iforest_spec_checks", f"""WITH {SESSIONS} SELECT client_name, count(*) + 1 AS n, 0 AS scores_differ, 1 AS planted_first FROM (SELECT DISTINCT {KEYS} FROM ev) GROUP BY client_name""")
def iforest_spec_checks(spark, sf):
    f = planted(rule_rows(spark, sf), ["client_name"], SPEC.features)
    scored = materialize(rank_by_forest(f, ("client_name",), SESSION_KEYS, SPEC), "scored")
    lo, hi = (F.expr(f"percentile(if_raw, {q})").over(Window.partitionBy("client_name")) for q in SPEC.scale)
    again = ranks_again(scored, ["client_name"]).withColumns({"lo": lo, "hi": hi})
    score = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("if_raw") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100))).otherwise(0.0)
    return again.withColumn("score", score).groupBy("client_name").agg(
        F.count("*").alias("n"), F.count_if(F.abs(F.col("score") - F.col("risk_score_if")) > 1e-6).alias("scores_differ"),
        F.max(F.when((F.col("session_key") == "planted") & (F.col("first") == 1), 1).otherwise(0)).alias("planted_first"))


@query("summary_checks", f"""WITH {WEEKLY}, {FEATURES_SQL} SELECT least(100, n) AS rows, least(100, n) AS sessions, 0 AS out_of_order, 0 AS without_details, least(100, n) AS details FROM (SELECT count(*) AS n FROM feat)""")
def summary_checks(spark, sf):
    """The forest's summary and its details: as many as asked for, ranked by their percentages, each with its details."""
    summary, details = A.summarize(A.score_features(weekly_features(spark, sf)), X.weekly_events(spark, sf), window_s=W)
    s = materialize(summary.select(*SESSION_KEYS, "risk_pct", "n_events", "n_events_dd", "why_ranked"), "summary")
    n = s.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*SESSION_KEYS)).alias("sessions"), F.count_if(~F.col("risk_pct").between(0, 100)).alias("out_of_order"),
              F.count_if(F.col("n_events_dd").isNull() | (F.col("n_events_dd") != F.col("n_events"))).alias("without_details"))
    return n.crossJoin(F.broadcast(details.agg(F.count_if(F.col("risk_pct").isNotNull()).alias("details"))))


@query("scored_details", f"""WITH {SESSIONS}, {DRILL}, {FEATURES_SQL} SELECT {KEYS}, n_events_dd, token_top3, n_events_dd + 0.0 AS risk_pct, n_events_dd / 2 + 0.0 AS risk_score FROM dd JOIN (SELECT {KEYS} FROM feat) USING ({KEYS})""")
def scored_details(spark, sf):
    """The second result of the ranking: details of the top sessions with their scores."""
    ev = X.session_events(spark, sf)
    f = Z.session_features(ev).withColumn("scope", F.concat(F.lit("a"), F.substring("day", 1, 0)))
    n = F.col("n_events").cast("double")
    scored = f.withColumns({"risk_pct": n, "risk_score": n / 2, "anomaly_score": n})
    few = materialize(longest(ev).select(*SESSION_KEYS), "top")
    return A.summarize(join_scope(scored, few, SESSION_KEYS, "left_semi"), ev, 100, ("scope",), W)[1].select(*SESSION_KEYS, "n_events_dd", "token_top3", "risk_pct", "risk_score")


@query("missing_details", f"""WITH {SESSIONS}, {DRILL} SELECT {KEYS}, CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN n_events_dd END AS n_events_dd, CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN token_top3 ELSE '' END AS token_top3,
  CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN timeline_1line ELSE '' END AS timeline_1line FROM dd""")
def missing_details(spark, sf):
    """Top sessions whose events are not at hand keep their place, with empty texts."""
    ev = X.session_events(spark, sf)
    top = materialize(longest(ev), "top")
    dd = D.drilldown(ev.where(F.col("user_id").cast("long") % 2 == 0), top, window_s=W)
    return D.with_details(top.select(*SESSION_KEYS), dd).select(*SESSION_KEYS, "n_events_dd", "token_top3", "timeline_1line")


@query("pack_packed_input", f"""WITH {SESSIONS}
SELECT client_name, '2024-01-01' AS day, user_id, session_key, chunk, list_aggregate(route_group, 'string_agg', ' ') AS route_group, list_aggregate(outcome_class, 'string_agg', ' ') AS outcome_class,
  list_aggregate(token, 'string_agg', ' ') AS token, 'packed_session' AS source_mode FROM (SELECT client_name, user_id, session_key, seq_no // 20 AS chunk, list(route_group ORDER BY seq_no) AS route_group,
  list(outcome_class ORDER BY seq_no) AS outcome_class, list(token ORDER BY seq_no) AS token FROM ev WHERE day < '2024-01-04' GROUP BY {KEYS}, seq_no // 20)""")
def pack_packed_input(spark, sf):
    """Packed rows under other column names are taken as they are."""
    p = P.pack_numbered(X.session_events(spark, sf).where("day < '2024-01-04'"), chunk_events=20)
    p = p.withColumnsRenamed({"token": "tokens", "outcome_class": "outcomes", "route_group": "route_groups", "event_time": "event_times"}).drop("dt_bucket")
    return P.pack(p, "2024-01-01").select(*SESSION_KEYS, "chunk", "route_group", "outcome_class", "token", "source_mode")


@query("pack_plain_rows", f"""WITH {SESSIONS}
SELECT client_name, '2024-01-01' AS day, user_id, session_key, route_group, outcome_class, token, '0' AS observation_id, 'session_fallback' AS source_mode FROM ev WHERE seq_no = 0 AND day < '2024-01-04'""")
def pack_plain_rows(spark, sf):
    """One plain row per session becomes arrays of one."""
    rows = X.session_events(spark, sf).where("seq_no = 0 and day < '2024-01-04'").select(*SESSION_KEYS, "route_group", "outcome_class", "token", "event_time")
    return P.pack(rows, "2024-01-01").withColumn("observation_id", F.transform("observation_id", lambda x: x.cast("string"))).select(
        *SESSION_KEYS, "route_group", "outcome_class", "token", "observation_id", "source_mode")


def report_sql(ctes: str, score: str, model: str, what: str) -> str:
    return f"""WITH {ctes}, {scaled(score, 'zero')}, r AS (
  SELECT *, row_number() OVER (PARTITION BY {PART} ORDER BY round(seq_raw, 9) DESC, session_key, user_id) AS rank FROM sc),
e AS (SELECT ev.* FROM ev JOIN r USING ({KEYS}) WHERE rank <= 3),
h AS (SELECT {KEYS}, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') || '~' || strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS span FROM e GROUP BY {KEYS})
SELECT 'p0' AS project_id, {KEYS}, rank, {r6('seq_raw')} AS seq_raw, {r6('risk_score_seq')} AS risk_score_seq, r.n_events, '{model}' AS model_type,
  CASE WHEN risk_score_seq >= 100 THEN 'RARE_{what}' WHEN risk_score_seq > 0 THEN 'UNUSUAL_{what}' ELSE 'TYPICAL' END AS primary_reason_code, 'span=' || span AS span
FROM r JOIN h USING ({KEYS}) WHERE rank <= 3"""


def report(spark, sf, model):
    ev = X.weekly_events(spark, sf).withColumn("project_id", F.lit("p0"))
    s = S.with_risk(S.MODELS[model](ev), flat="zero").withColumn("seq_raw", F.round("seq_raw", 9))
    r = S.sequence_summary(s, model, 3, events=ev, window_s=W)
    return r.withColumn("span", F.substring_index("timeline_1line", " | ", 1)).drop("timeline_1line")


@query("b2_report", report_sql(GRAMS + f""", b2 AS (SELECT {KEYS}, coalesce(x.raw, 0) AS seq_raw, n.n_events FROM (SELECT {KEYS}, count(*) AS n_events FROM ev GROUP BY {KEYS}) n
  LEFT JOIN (SELECT {KEYS}, avg(nll) AS raw FROM gs GROUP BY {KEYS}) x USING ({KEYS}))""", "b2", "B2", "NGRAMS"))
def b2_report(spark, sf):
    return report(spark, sf, "b2")


@query("b3_report", report_sql(B3 + """, b3r AS (SELECT *, abs(entropy_session - entropy_median_partition) AS seq_raw FROM b3)""", "b3r", "B3", "ENTROPY"))
def b3_report(spark, sf):
    return report(spark, sf, "b3")


@query("split_blake_checks", f"WITH {SESSIONS} SELECT count(*) AS n, 1 AS shares_hold, 0 AS unknown FROM (SELECT DISTINCT {KEYS} FROM ev)")
def split_blake_checks(spark, sf):
    """The other hash puts every session in one of the three splits, in about the same shares."""
    s = K.with_split(X.session_events(spark, sf).select(*SESSION_KEYS).distinct(), blake=True)
    share = F.count_if(F.col("split") == "train") / F.count("*")
    return s.agg(F.count("*").alias("n"), F.when(share.between(0.8, 0.98), 1).otherwise(0).alias("shares_hold"), F.count_if(~F.col("split").isin("train", "val", "test")).alias("unknown"))


@query("pca_checks", f"WITH {SESSIONS} SELECT client_name, count(*) AS n, 0 AS negative, 0 AS left_by_all_axes FROM (SELECT DISTINCT {KEYS} FROM ev) GROUP BY client_name")
def pca_checks(spark, sf):
    """Distances are never negative, and with as many axes as dimensions nothing is left."""
    ev = X.session_events(spark, sf)
    few, every = (L.reconstruction_scores(ev, dims=16, components=c).select(*SESSION_KEYS, F.col("score_reconstruction").alias(f"c{c}")) for c in (4, 16))
    return few.join(every, list(SESSION_KEYS)).groupBy("client_name").agg(F.count("*").alias("n"), F.count_if(F.col("c4") < 0).alias("negative"), F.count_if(F.col("c16") > 1e-6).alias("left_by_all_axes"))


@query("weak_clf_checks", f"""WITH {SESSIONS} SELECT count(*) AS n, 0 AS out_of_range, 1 AS ranks_labels FROM (SELECT DISTINCT {KEYS} FROM ev)""")
def weak_clf_checks(spark, sf):
    """A probability for every session, higher on average where the label is 1."""
    ev = X.session_events(spark, sf)
    s = L.weak_label_scores(ev, K.with_split(V.weak_labels(ev)), token="route_group")
    mean = lambda v: F.avg(F.when(F.col("label") == v, F.col("score_weak_label")))
    return s.agg(F.count("*").alias("n"), F.count_if(~F.col("score_weak_label").between(0, 1)).alias("out_of_range"), (mean(1) > mean(0)).cast("int").alias("ranks_labels"))


@query("seed_checks", f"""WITH {WEEKLY}, {FEATURES_SQL}, s AS (SELECT count(*) AS n FROM feat)
SELECT seed, least(50, n) AS top, 1 AS precision_holds, 1 AS differs FROM s, (SELECT unnest([1, 2, 3]) AS seed)""")
def seed_checks(spark, sf):
    """Forests of several seeds in one draw and one fit: the seed is part of the scope and of the draw's key."""
    f = materialize(weekly_features(spark, sf), "features").withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    r = rank_by_forest(f, ("seed", "day"), ("seed", *SESSION_KEYS), replace(IMPL, trees=50))
    r = materialize(r.select("seed", *SESSION_KEYS, "if_raw"), "scores")
    top = St.top_k(r, ["seed"], [F.desc("if_raw"), *SESSION_KEYS], 50)
    labels = V.weak_labels(X.weekly_events(spark, sf)).withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    p = V.precision_at_k(r, labels, ["if_raw"], (50,), keys=("seed", *SESSION_KEYS), part=("seed",))
    spread = r.groupBy(*SESSION_KEYS).agg(F.stddev_pop("if_raw").alias("d")).agg(F.max("d").alias("d"))
    counted = top.groupBy("seed").agg(F.count("*").alias("top")).join(p.select("seed", F.col("precision_at_k").between(0, 1).cast("int").alias("precision_holds")), "seed")
    return counted.crossJoin(F.broadcast(spread.select((F.col("d") > 0).cast("int").alias("differs"))))


@query("cost_checks", f"""WITH {WEEKLY}, s AS (SELECT count(*) AS n FROM (SELECT DISTINCT {KEYS} FROM ev)) SELECT model, n AS rows, 1 AS timed, 1 AS relative FROM s, (SELECT unnest(['b1', 'b2', 'b3']) AS model)""")
def cost_checks(spark, sf):
    from .q_evaluate import costs
    c = costs(spark, sf)
    return c.select("model", "rows", (F.col("seconds") > 0).cast("int").alias("timed"), (F.col("relative_cost") >= 1).cast("int").alias("relative"))


@query("fingerprint_checks", """SELECT 'events' AS "table", count(*) AS rows, 1 AS order_free, 1 AS sees_changes FROM events UNION ALL SELECT 'orders', count(*), 1, 1 FROM orders""")
def fingerprint_checks(spark, sf):
    """Equal for rows in another order, different as soon as a row is."""
    parts = []
    for t, number in (("events", "event_id"), ("orders", "o_orderkey")):
        df = X.read(spark, sf, t)
        last = df.agg(F.max(number).alias("_last"))
        changed = df.crossJoin(F.broadcast(last)).withColumn(number, F.when(F.col(number) == F.col("_last"), F.col(number) + 1).otherwise(F.col(number))).drop("_last")
        a, b, c = (writers.fingerprint(x).select(*(F.col(n).alias(f"{n}_{i}") for n in ("rows", "xor_hash", "sum_hash"))) for i, x in enumerate((df, df.repartition(7, number), changed)))
        one = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))   # one row each
        parts.append(one.select(F.lit(t).alias("table"), F.col("rows_0").alias("rows"), ((F.col("xor_hash_0") == F.col("xor_hash_1")) & (F.col("sum_hash_0") == F.col("sum_hash_1"))).cast("int").alias("order_free"),
                                ((F.col("xor_hash_0") != F.col("xor_hash_2")) & (F.col("sum_hash_0") != F.col("sum_hash_2"))).cast("int").alias("sees_changes")))
    return parts[0].unionByName(parts[1])


MANIFEST = [("user_id", "string"), ("client_name", "string"), ("session_id", "string"), ("event_time", "timestamp"), ("seq_no", "bigint"), ("prev_time", "timestamp"), ("session_key", "string"),
            ("day", "string"), ("dt_ms", "bigint"), ("dt_bucket", "string"), ("token", "string")]


@query("manifest", f"WITH {SESSIONS} " + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, '{'client, operation, outcome, gap' if c == 'token' else ''}' AS note, count({c}) AS filled_rows FROM ev" for i, (c, t) in enumerate(MANIFEST)))
def manifest(spark, sf):
    ev = X.session_events(spark, sf).select(*(c for c, _ in MANIFEST))
    filled = ev.agg(*[F.count(c).alias(c) for c in ev.columns]).unpivot([], ev.columns, "column", "filled_rows")
    return writers.schema_manifest(ev, {"token": "client, operation, outcome, gap"}).join(filled, "column").drop("nullable")


@query("run_record", f"""WITH {SESSIONS}, n AS (SELECT count(*) AS rows, count(DISTINCT ({KEYS})) AS sessions FROM ev)
SELECT '{Art.SPEC_VERSION}' AS spec_version, '{Art.REVISION}' AS revision, '1.0.0' AS feature_version, 'client_name' AS model_scope, '7 days' AS time_window_guard, 200 AS topk_k, 'client_name' AS partition_keys,
  '{",".join(SESSION_KEYS)}' AS session_keys, '{Art.TIE_BREAKERS}' AS ranking_tiebreakers, rows AS input_rows, sessions AS sessions_written, 1 AS hashes_differ, 200 AS trees FROM n""")
def run_record(spark, sf):
    """The record of a run, without its time; of the hashes only that they tell two sets of rules apart."""
    ev = X.session_events(spark, sf)
    rules = materialize(rule_rows(spark, sf).select(*SESSION_KEYS, "risk_score_v2"), "rules")
    r = Art.run_record(ev, ("client_name",), {"sessions": rules})
    other = Art.rules_hash(replace(SPEC, rate_limit_heavy=0.5))
    return r.select("spec_version", "revision", "feature_version", "model_scope", "time_window_guard", "topk_k", "partition_keys", "session_keys", "ranking_tiebreakers", "input_rows",
                    F.col("rows_written")["sessions"].alias("sessions_written"), (F.col("risk_tag_rules_hash") != other).cast("int").alias("hashes_differ"), F.get_json_object("if_params", "$.trees").cast("int").alias("trees"))

"""Rule-based risk: features of the specification, score components, tags, reasons, labels, triage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..profiles import IMPL, SPEC, Profile
from .drilldown import peak_window

# Fixed values of the rules.
WEIGHTS = {"s_error": 0.35, "s_rl": 0.25, "s_burst": 0.25, "s_route": 0.10, "s_long": 0.05}
ATOMIC_TAGS = ["ERROR_HEAVY", "RATE_LIMIT_HEAVY", "BURST", "EXTREME_BURST", "ROUTE_SKEW", "LONG_DURATION",
               "TIME_UNRELIABLE", "EMPTY_SESSION", "NORMAL_LONG_SESSION_HINT"]
LABELS = ["suspicious", "needs_review", "benign_fp", "normal"]


def rule_features(events: DataFrame, keys: Sequence[str], start: str, end: str, guard_days: int = 7,
                  window_s: int = 30, tz: str = "Asia/Seoul") -> DataFrame:
    """The six specified features with counters, per session of (event_time, route_group, outcome, seq_no) rows.

    Sessions with an unusable time keep their rates; their duration and peak are 0, their day is that of
    `trace_created_at` where the rows have it.
    """
    t = F.col("event_time")
    guard = F.make_dt_interval(F.lit(guard_days))
    fine = (t.isNotNull() & (t >= F.lit(start).cast("timestamp") - guard)
            & (t <= F.lit(end).cast("timestamp") + guard) & (F.year(t) != 1970))
    err, rl = F.col("outcome") == "error", F.col("outcome") == "rate_limited"
    traced = F.col("trace_created_at") if "trace_created_at" in events.columns else F.lit(None).cast("timestamp")
    base = events.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("time_valid"),
        F.min(traced).alias("traced"), F.min(t).alias("t0"), F.max(t).alias("t1"),
        F.count_if(F.col("outcome") == "ok").alias("ok_count"), F.count_if(err).alias("error_count"),
        F.count_if(rl).alias("rate_limited_count"),
        F.min(F.when(err, t)).alias("first_err"), F.min(F.when(rl, t)).alias("first_rl"))
    top = (events.groupBy(*keys, "route_group").agg(F.count("*").alias("c"))
           .groupBy(*keys).agg(F.max("c").alias("top_route")))
    n, ok = F.col("n_events"), F.col("time_valid")
    return (base.join(top, list(keys)).join(peak_window(events, keys, window_s), list(keys), "left")
            .withColumns({
                "duration_sec": F.when(ok, F.greatest(F.lit(0.0), C.elapsed_s(F.col("t0"), F.col("t1")))).otherwise(0.0),
                "peak30s": F.when(ok, F.coalesce("peak_events", F.lit(0))).otherwise(F.lit(0)),
                "time_unreliable_count": F.when(ok, F.lit(0)).otherwise(n),
                "error_rate": F.col("error_count") / n, "rate_limited_rate": F.col("rate_limited_count") / n,
                "route_skew": F.col("top_route") / n,
                "local_day": F.when(ok, C.local_day(F.col("t0"), tz)).otherwise(C.local_day(F.col("traced"), tz))})
            .drop("traced", "top_route", "peak_events", "peak_start", "peak_end"))


def components() -> dict[str, Column]:
    long = F.ln(1 + F.col("duration_sec")) - math.log(1 + 1800)
    return {
        "s_error": C.clip01((F.col("error_rate") - 0.05) / 0.35),
        "s_rl": C.clip01((F.col("rate_limited_rate") - 0.02) / 0.30),
        "s_burst": C.clip01((F.col("peak30s") - 8) / 20.0),
        "s_route": C.clip01((F.col("route_skew") - 0.70) / 0.30),
        "s_long": C.clip01(long / (math.log(1 + 21600) - math.log(1 + 1800))),
    }


def long_normal() -> Column:
    return (F.col("error_rate") == 0) & (F.col("rate_limited_rate") < 0.02) & (F.col("duration_sec") >= 3600)


def with_risk_v2(df: DataFrame) -> DataFrame:
    """Component scores, their weighted sum, and the lower score of long sessions without trouble."""
    df = df.withColumns(components())
    total = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)) * 100.0
    return (df.withColumn("risk_score_v2_raw", total)
            .withColumn("risk_score_v2", F.when(long_normal(), F.col("risk_score_v2_raw") * 0.6).otherwise(F.col("risk_score_v2_raw"))))


def tag_rules(profile: Profile = SPEC) -> dict[str, tuple[Column, Column]]:
    """Tag -> (condition, observed value as text)."""
    er, rl, pk = F.col("error_rate"), F.col("rate_limited_rate"), F.col("peak30s")
    sk, du, n = F.col("route_skew"), F.col("duration_sec"), F.col("n_events")
    heavy_err, heavy_rl = er >= 0.20, rl >= profile.rate_limit_heavy
    return {
        "ERROR_HEAVY": (heavy_err, er), "RATE_LIMIT_HEAVY": (heavy_rl, rl),
        "BURST": (pk >= 20, pk), "EXTREME_BURST": (pk >= 40, pk),
        "ROUTE_SKEW": (sk >= 0.90, sk), "LONG_DURATION": (du >= profile.long_duration_s, du),
        "TIME_UNRELIABLE": (~F.col("time_valid"), F.col("time_unreliable_count")),
        "EMPTY_SESSION": (n == 0, n), "NORMAL_LONG_SESSION_HINT": (long_normal(), du),
        "RETRY_STORM": ((heavy_rl | heavy_err) & (pk >= 20), pk),
        "POLICY_PRESSURE": (heavy_rl & ((sk >= 0.80) | (pk >= 20)), rl),
        "SINGLE_ROUTE_LOOP": ((sk >= 0.95) & (n >= 20), sk),
    }


def with_tags(df: DataFrame, profile: Profile = SPEC) -> DataFrame:
    """`risk_tags` (sorted) and `threshold_hits` (tag with the value that set it off)."""
    rules = tag_rules(profile)
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(t).alias("tag"), v.cast("double").alias("value")))
                                     for t, (cond, v) in rules.items()]))
    return df.withColumn("threshold_hits", F.array_sort(hits)).withColumn("risk_tags", F.transform("threshold_hits", lambda h: h.tag))


def has(tag: str) -> Column:
    return F.array_contains("risk_tags", tag)


def reason_code() -> Column:
    return (F.when(has("TIME_UNRELIABLE"), "TIME_UNRELIABLE")
            .when(has("RETRY_STORM"), F.when(F.col("rate_limited_rate") >= F.col("error_rate"), "RATE_LIMIT").otherwise("ERROR"))
            .when(has("EXTREME_BURST"), "BURST").when(has("ERROR_HEAVY"), "ERROR").when(has("RATE_LIMIT_HEAVY"), "RATE_LIMIT")
            .when(has("ROUTE_SKEW"), "ROUTE_SKEW").when(has("LONG_DURATION"), "LONG").otherwise("MIXED"))


def suggested_label() -> Column:
    s = F.col("risk_score_v2")
    return (F.when(s >= 80, "suspicious")
            .when(has("EXTREME_BURST") & (has("ERROR_HEAVY") | has("RATE_LIMIT_HEAVY")), "suspicious")
            .when(has("NORMAL_LONG_SESSION_HINT"), "benign_fp").when(s >= 50, "needs_review").otherwise("normal"))


def suggested_action() -> Column:
    """Suspicious bursts and rate-limit pressure become candidates for blocking and limiting; the rest is watched."""
    label = F.col("label_suggested")
    return (F.when((label == "suspicious") & has("BURST"), "block_candidate")
            .when((label == "suspicious") & has("RATE_LIMIT_HEAVY"), "rate_limit_candidate")
            .when(label.isin("suspicious", "needs_review"), "review").otherwise("monitor"))


def confidence() -> Column:
    s, label = F.col("risk_score_v2"), F.col("label_suggested")
    return (F.when(label == "suspicious", F.least(F.lit(1.0), 0.60 + 0.40 * C.clip01((s - 80) / 20)))
            .when(label == "needs_review", 0.30 + 0.30 * C.clip01((s - 50) / 30))
            .when(label == "benign_fp", 0.70).otherwise(0.20))


def with_labels(df: DataFrame) -> DataFrame:
    df = df.withColumn("primary_reason_code", reason_code()).withColumn("label_suggested", suggested_label())
    return df.withColumn("action_suggested", suggested_action()).withColumn("confidence", confidence())


def component_breakdown() -> Column:
    return F.struct(*WEIGHTS, F.create_map(*[x for c, w in WEIGHTS.items() for x in (F.lit(c), F.lit(w))]).alias("weights"),
                    "risk_score_v2_raw")


def rule_timeline(tz: str = "Asia/Seoul") -> Column:
    """Fixed-format line; needs the columns of `rule_features` and `top3_routes`."""
    def iso(ts: Column) -> Column:
        return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd'T'HH:mm:ss")

    ok, dash = F.col("time_valid"), F.lit("-")

    def first(c: str) -> Column:
        return F.when(ok, F.coalesce(iso(F.col(c)), dash)).otherwise(dash)

    bad = F.lit("TIME_UNRELIABLE")
    return F.concat(F.when(ok, iso(F.col("t0"))).otherwise(bad), F.lit(".."), F.when(ok, iso(F.col("t1"))).otherwise(bad),
                    F.lit(" (dur="), C.fixed(F.col("duration_sec"), 0), F.lit("s); n="), F.col("n_events").cast("string"),
                    F.lit("; peak30s="), F.col("peak30s").cast("string"), F.lit("; routes="), F.coalesce("top3_routes", F.lit("")),
                    F.lit("; outcomes=ok:"), F.col("ok_count").cast("string"), F.lit(" err:"), F.col("error_count").cast("string"),
                    F.lit(" rl:"), F.col("rate_limited_count").cast("string"), F.lit("; first_err="), first("first_err"),
                    F.lit("; first_rl="), first("first_rl"))


def top_routes(events: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """`route:count(share)` of the k most used routes of each session."""
    from .stats import top_k
    counts = events.groupBy(*keys, "route_group").agg(F.count("*").alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    best = top_k(counts, keys, [F.desc("c"), F.asc("route_group")], k, "r").join(total, list(keys))
    text = F.concat("route_group", F.lit(":"), F.col("c").cast("string"), F.lit("("), C.fixed(F.col("c") / F.col("n")), F.lit(")"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("r", text.alias("s")))), lambda x: x.s), ", ").alias("top3_routes"))


def with_ranked_tags(top: DataFrame, profile: Profile = IMPL) -> DataFrame:
    """Tags and the reason text for sessions with drilldown columns: `risk_tags`, `why_ranked`."""
    er, rl, mx = F.col("error_rate_dd"), F.col("rate_limited_rate_dd"), F.col("max_events_in_30s")
    bs, du, nt, sk = F.col("burst_score"), F.col("duration_s"), F.col("n_tokens_dd"), F.col("route_skew")
    burst = F.coalesce(mx >= 20, F.lit(False))
    rules = [
        ("ERROR_HEAVY", er >= 0.20, F.concat(F.lit("error_rate="), C.percent(er))),
        ("RATE_LIMIT_HEAVY", rl >= profile.rate_limit_heavy, F.concat(F.lit("rate_limited_rate="), C.percent(rl))),
        ("BURST", burst, F.concat(F.lit("burst_peak30s="), mx.cast("long").cast("string"))),
        ("BURST_DENSE", ~burst & (bs >= 0.05), F.concat(F.lit("burst_score="), C.fixed(bs))),
        ("LONG_DURATION", du >= profile.long_duration_s, F.concat(F.lit("duration_s="), C.fixed(du, 0))),
        ("TOKEN_DIVERSE", nt >= 10, F.concat(F.lit("n_unique_tokens="), nt.cast("long").cast("string"))),
        ("ROUTE_SKEW", sk >= 0.90, F.concat(F.lit("route_skew="), C.percent(sk))),
    ]
    tags = F.concat_ws(",", *[F.when(cond, F.lit(t)) for t, cond, _ in rules])
    why = [F.when(cond, text) for _, cond, text in rules]
    if "why_top5" in top.columns:
        why.append(F.when(F.trim("why_top5") != "", F.concat(F.lit("features: "), "why_top5")))
    return top.withColumn("risk_tags", tags).withColumn("why_ranked", F.concat_ws(" | ", *why))


def with_triage(df: DataFrame) -> DataFrame:
    """Reading aids for the summary: bands of error rate, peak and route skew, and session patterns.

    A value between two printed bands belongs to the upper one.
    """
    er, pk, sk, du = F.col("error_rate"), F.col("peak30s"), F.col("route_skew"), F.col("duration_sec")
    return df.withColumns({
        "error_band": F.when(er == 0, "clean").when(er <= 0.05, "ordinary_failures").when(er <= 0.30, "retrying").otherwise("runaway"),
        "peak_band": F.when(pk < 5, "normal").when(pk <= 15, "active").when(pk < 40, "burst").otherwise("automation"),
        "skew_band": F.when(sk <= 0.60, "spread").when(sk < 1.0, "focused").otherwise("single_route"),
        "retry_loop": (pk >= 20) & (er >= 0.10) & (F.col("rate_limited_rate") >= 0.10),
        "long_normal_session": (du >= 3600) & (er <= 0.05) & (sk >= 0.80)})


def evasive_users(df: DataFrame, user: Sequence[str], short_s: float = 600.0, least: int = 3) -> DataFrame:
    """Users with several short sessions that run into limits in bursts."""
    hit = (F.col("duration_sec") <= short_s) & (F.col("rate_limited_rate") >= 0.10) & (F.col("peak30s") >= 5)
    return (df.groupBy(*user).agg(F.count_if(hit).alias("limited_short_sessions"), F.count("*").alias("sessions"))
            .withColumn("limit_evasion", F.col("limited_short_sessions") >= least))


def excluded(packed: DataFrame, keys: Sequence[str], required: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Sessions kept out of the ranking, with the reason."""
    from .pack import empty_sessions, explode_meta
    rows = empty_sessions(explode_meta(packed, required, required), required)
    return rows.select(*keys, *extra, F.lit("EMPTY_SESSION").alias("exclude_reason"),
                       F.array(F.lit("EMPTY_SESSION")).alias("risk_tags"), "explode_meta")

"""What happened inside the sessions at the top of a ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import SESSION_KEYS, keys_of
from ..staging import materialize
from .pack import unpack
from .scan import neighbours
from .stats import quantiles


def peak_window(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, window_s: int = 30) -> DataFrame:
    """Most events inside any `window_s` seconds (both ends count), with the first such window.

    Time is cut into blocks of the window's length. A window ending at t begins in t's block or the one
    before, so a copy of each event time and a probe at t - window go to the block before, and one running
    pass per (session, block) finds for each probe the first event that is still inside.
    """
    keys = keys_of(keys, events)
    width = window_s * 1_000_000
    at = events.where(F.col("event_time").isNotNull()).groupBy(*keys, F.unix_micros("event_time").alias("us")).agg(
        F.min("seq_no").alias("lo"), F.max("seq_no").alias("hi"))
    block = ((F.col("us") - F.pmod("us", F.lit(width))) / width).cast("long")

    def row(b: Column, pos: Column, probe: int) -> Column:
        return F.struct(b.alias("b"), pos.alias("pos"), F.lit(probe).alias("probe"))

    rows = at.select(*keys, "us", "lo", "hi", F.inline(F.array(
        row(block, F.col("us"), 0), row(block - 1, F.col("us"), 0), row(block - 1, F.col("us") - width, 1))))
    back = (Window.partitionBy(*keys, "b").orderBy(F.desc("pos"), F.asc("probe"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.last(F.when(F.col("probe") == 0, F.struct("us", "lo")), ignorenulls=True).over(back)
    ends = rows.withColumn("first", first).where(F.col("probe") == 1)
    n = F.col("hi") - F.col("first.lo") + 1
    best = F.max(F.struct(n.alias("n"), (-F.col("us")).alias("end"), F.col("first.us").alias("start")))
    return ends.groupBy(*keys).agg(best.alias("p")).select(
        *keys, F.col("p.n").alias("peak_events"), F.timestamp_micros("p.start").alias("peak_start"),
        F.timestamp_micros(-F.col("p.end")).alias("peak_end"))


def gap_quantiles(events: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Median and p95 of the seconds between neighbouring events."""
    keys = keys_of(keys, events)
    gaps = events.where(F.col("prev_time").isNotNull()).select(*keys, C.elapsed_s(F.col("prev_time"), F.col("event_time")).alias("gap"))
    return quantiles(gaps, list(keys), "gap", {"p50_gap_s": 0.50, "p95_gap_s": 0.95}).drop("n_values")


VALUE_COLUMNS = {"token": "token_top3", "route_group": "route_group_top3", "outcome_class": "outcome_top3", "dt_bucket": "dt_bucket_top3"}


def value_counts(events: DataFrame, keys: Sequence[str], columns: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """How often each value of each column occurs per session, with flagged rows counted beside; `*` is every row."""
    cells = [F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns]
    every = F.struct(F.lit("*").alias("col"), F.lit("").alias("val"))
    rows = events.select(*keys, *[f.cast("int").alias(n) for n, f in flags.items()], F.inline(F.array(every, *cells)))
    return rows.where(F.col("val").isNotNull()).groupBy(*keys, "col", "val").agg(
        F.count("*").alias("c"), *[F.sum(n).alias(n) for n in flags])


def drilldown(events: DataFrame, wanted: DataFrame, keys: Sequence[str] = SESSION_KEYS, window_s: int = 30) -> DataFrame:
    """One row of details per wanted session. `wanted` is a top-k list; its events are cut out first."""
    keys = keys_of(keys, events, wanted)
    cols = [c for c in VALUE_COLUMNS if c in events.columns]
    ev = materialize(events.join(wanted.select(*keys), list(keys), "left_semi")
                     .select(*keys, "seq_no", "event_time", "prev_time", *cols), "drill")
    out = F.col("outcome_class")
    vals = value_counts(ev, keys, cols, {"err": C.error_like(out), "rl": C.rate_limit_like(out)})
    vals = vals.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "col").orderBy(F.desc("c"), F.asc("val"))))

    def top3(c: str) -> Column:
        cell = F.when((F.col("col") == c) & (F.col("r") <= 3),
                      F.struct("r", F.concat("val", F.lit("("), F.col("c").cast("string"), F.lit(")")).alias("s")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x.s), ", ")

    every, is_route = F.col("col") == "*", F.col("col") == "route_group"
    worst = F.min(F.when(is_route & (F.col("err") > 0), F.struct((-F.col("err")).alias("e"), F.col("val").alias("v"))))
    d = vals.groupBy(*keys).agg(
        F.max(F.when(every, F.col("c"))).alias("n_events_dd"),
        F.count_if(F.col("col") == "token").alias("n_tokens_dd"),
        F.count_if(F.col("col") == "outcome_class").alias("n_outcomes_dd"),
        *[top3(c).alias(VALUE_COLUMNS[c]) for c in cols],
        F.max(F.when(every, F.col("err") / F.col("c"))).alias("error_rate_dd"),
        F.max(F.when(every, F.col("rl") / F.col("c"))).alias("rate_limited_rate_dd"),
        F.max(F.when(is_route, F.col("c"))).alias("_top_route"), worst.alias("_worst"))
    times = ev.groupBy(*keys).agg(F.min("event_time").alias("first_ts"), F.max("event_time").alias("last_ts"))
    d = (d.join(times, list(keys)).join(peak_window(ev, keys, window_s), list(keys), "left")
         .join(gap_quantiles(ev, keys), list(keys), "left"))
    d = d.withColumns({
        "route_skew": F.col("_top_route") / F.col("n_events_dd"),
        "max_events_in_30s": F.col("peak_events").cast("double"),
        "top_error_route": F.coalesce(F.concat("_worst.v", F.lit("("), (-F.col("_worst.e")).cast("string"), F.lit(")")), F.lit("")),
        "peak_30s_events": F.coalesce("peak_events", F.lit(0)),
    }).withColumns({
        "route_skew_pct": F.coalesce(C.percent(F.col("route_skew")), F.lit("")),
        "burst_score": burst_score(F.col("max_events_in_30s"), F.col("n_events_dd")),
    }).withColumnsRenamed({"peak_start": "peak_30s_start", "peak_end": "peak_30s_end"})
    return d.withColumn("timeline_1line", timeline()).drop("_top_route", "_worst", "peak_events")


def burst_score(peak: Column, n: Column) -> Column:
    return peak / (n + 1e-9)


def _clock(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def timeline() -> Column:
    """One line per session; parts that are unknown are left out."""
    span = F.concat(F.lit("span="), _clock(F.col("first_ts")), F.lit("~"), _clock(F.col("last_ts")))
    peak = F.when(F.col("peak_30s_events") > 0, F.concat(
        F.lit("peak30s="), F.col("peak_30s_events").cast("string"), F.lit("@"), _clock(F.col("peak_30s_start")),
        F.lit("~"), _clock(F.col("peak_30s_end"))))
    route = F.when(F.col("top_error_route") != "", F.concat(F.lit("top_error_route="), "top_error_route"))
    return F.concat_ws(" | ", span, peak, route, F.concat(F.lit("error_rate="), C.percent(F.col("error_rate_dd"))),
                       F.concat(F.lit("rate_limited_rate="), C.percent(F.col("rate_limited_rate_dd"))))


def drilldown_packed(packed: DataFrame, wanted: DataFrame, keys: Sequence[str] = SESSION_KEYS, window_s: int = 30) -> DataFrame:
    """The same details from packed sessions: the wanted ones are cut out before their arrays are unpacked."""
    keys = keys_of(keys, packed, wanted)
    ev = unpack(packed.join(wanted.select(*keys), list(keys), "left_semi"), keys)
    return drilldown(neighbours(ev, keys, "seq_no", behind={"prev_time": ("event_time", 1)}), wanted, keys, window_s)


def drilldown_arrays(packed: DataFrame, wanted: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Details from arrays alone, without times; same columns, unknown ones null. A session's chunks are counted together."""
    keys = keys_of(keys, packed, wanted)
    p = packed.join(wanted.select(*keys), list(keys), "left_semi")

    def cells_of(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(c).alias("col"), v.alias("val")))

    cells = [cells_of(c) for c in ("token", "route_group", "outcome_class")]
    vals = p.select(*keys, F.inline(F.flatten(F.array(*cells)))).groupBy(*keys, "col", "val").agg(F.count("*").alias("c"))
    known = F.col("val").isNotNull()
    rank = F.row_number().over(Window.partitionBy(*keys, "col").orderBy(F.desc(known), F.desc("c"), F.asc("val")))
    vals = vals.withColumn("r", rank)

    def top3(c: str) -> Column:
        cell = F.when((F.col("col") == c) & known & (F.col("r") <= 3),
                      F.struct("r", F.concat("val", F.lit("("), F.col("c").cast("string"), F.lit(")")).alias("s")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x.s), ", ")

    def total(c: str, test: Column | None = None) -> Column:
        return F.sum(F.when((F.col("col") == c) & (F.lit(True) if test is None else test), F.col("c")).otherwise(0))

    out = F.col("val")
    n_out, n_routes = total("outcome_class"), total("route_group")
    found = vals.groupBy(*keys).agg(
        total("token").alias("n_events_dd"), F.count_if(F.col("col") == "token").alias("n_tokens_dd"),
        F.count_if(F.col("col") == "outcome_class").alias("n_outcomes_dd"), top3("token").alias("token_top3"),
        top3("route_group").alias("route_group_top3"), top3("outcome_class").alias("outcome_top3"),
        (total("outcome_class", C.error_like(out)) / F.nullif(n_out, F.lit(0))).alias("error_rate_dd"),
        (total("outcome_class", C.rate_limit_like(out)) / F.nullif(n_out, F.lit(0))).alias("rate_limited_rate_dd"),
        F.when(n_routes > 0, F.max(F.when((F.col("col") == "route_group") & known, F.col("c"))) / (n_routes + 1e-9)).alias("route_skew"))
    none, ts = F.lit(None).cast("double"), F.lit(None).cast("timestamp")
    d = p.select(*keys).distinct().join(found, list(keys), "left")    # sessions without any value stay
    d = d.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_events_dd", "n_tokens_dd", "n_outcomes_dd")})
    d = d.withColumns({c: F.coalesce(c, F.lit("")) for c in ("token_top3", "route_group_top3", "outcome_top3")})
    return d.select(
        *keys, "n_events_dd", "n_tokens_dd", "n_outcomes_dd", "token_top3", "route_group_top3", "outcome_top3",
        F.lit("").alias("dt_bucket_top3"), "error_rate_dd", "rate_limited_rate_dd", "route_skew",
        F.coalesce(C.percent(F.col("route_skew")), F.lit("")).alias("route_skew_pct"), none.alias("burst_score"),
        ts.alias("first_ts"), ts.alias("last_ts"), ts.alias("peak_30s_start"), ts.alias("peak_30s_end"),
        F.lit(0).cast("long").alias("peak_30s_events"), none.alias("max_events_in_30s"), none.alias("p50_gap_s"),
        none.alias("p95_gap_s"), F.lit("").alias("top_error_route"), F.lit("").alias("timeline_1line"))


TEXT_DETAILS = ("token_top3", "route_group_top3", "outcome_top3", "dt_bucket_top3", "route_skew_pct", "top_error_route", "timeline_1line")


def with_details(top: DataFrame, details: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Attach details; sessions without any get nulls and empty texts."""
    keys = keys_of(keys, top, details)
    j = top.join(details, list(keys), "left")
    return j.withColumns({c: F.coalesce(c, F.lit("")) for c in TEXT_DETAILS if c in details.columns})


def histogram(events: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Map from value to its count and share in the session."""
    counts = events.groupBy(*keys, F.col(col).alias("v")).agg(F.count("*").alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    cell = F.struct("v", F.struct(F.col("c").alias("count"), (F.col("c") / F.col("n")).alias("share")).alias("s"))
    return counts.join(total, list(keys)).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias(out))

"""Exact order statistics without collecting a group in one place.

Spark's own exact percentile keeps every distinct value of a group in one task. Here values are first
counted, then counted again per bucket of a fixed monotone grid; only the bucket totals (a bounded
table) are summed along a window, and each bucket is ranked by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import join_scope, materialize, small_side

GRID = 4096.0
FINEST = 1e-9


def grid_bucket(x: Column) -> Column:
    """Monotone bucket number with about 4096 buckets per factor e; at most some 500,000 in all."""
    return (F.signum(x) * F.floor(F.ln(1.0 + F.abs(x) / FINEST) * GRID)).cast("long")


def value_counts(df: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each partition: `_v`, its number of rows `_n`, its bucket `_b`."""
    return (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*part, F.col(value).cast("double").alias("_v"))
            .agg(F.count("*").alias("_n")).withColumn("_b", grid_bucket(F.col("_v"))))


def bucket_totals(values: DataFrame, part: Sequence[str]) -> DataFrame:
    """Bucket totals with the bucket's ends, the number of smaller rows and of all rows."""
    whole = Window.partitionBy(*part)
    below = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (values.groupBy(*part, "_b").agg(F.sum("_n").alias("_bn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            .withColumn("_below", F.coalesce(F.sum("_bn").over(below), F.lit(0)))
            .withColumn("_total", F.sum("_bn").over(whole)))


def _counted(df: DataFrame, part: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    values = value_counts(df, part, value)
    return values, bucket_totals(values, part).drop("_lo", "_hi")


def _ranked(values: DataFrame, buckets: DataFrame, part: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*part, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return (join_scope(values, buckets, [*part, "_b"])
            .withColumn("_less", F.col("_below") + F.coalesce(F.sum("_n").over(w), F.lit(0))))


def value_ranks(df: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: `n_less`, `n_equal`, `n_total` within the partition."""
    ranked = _ranked(*_counted(df, part, value), part)
    return ranked.select(*part, F.col("_v").alias(value), F.col("_less").alias("n_less"),
                         F.col("_n").alias("n_equal"), F.col("_total").alias("n_total"))


def percent_rank(df: DataFrame, part: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank as a percentage, ties at their average."""
    ranks = value_ranks(df, part, value).select(
        *part, value, ((F.col("n_less") + (F.col("n_equal") + 1) / 2.0) / F.col("n_total") * 100.0).alias(out))
    return join_scope(df, ranks, [*part, value], "left")


def _covers(rank: Column, start: Column, n: Column) -> Column:
    return (rank >= start) & (rank < start + n)


def _picked(ranked: DataFrame, part: Sequence[str], qs: dict[str, float], value: str, start: str) -> DataFrame:
    """Linear quantiles from rows that hold each wanted rank: `start` rows come before the `_n` rows of `value`."""
    spots = {name: q * (F.col("_total") - 1).cast("double") for name, q in qs.items()}
    picks = []
    for name, spot in spots.items():
        for end, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            picks.append(F.max(F.when(_covers(rank, F.col(start), F.col("_n")), F.col(value))).alias(f"_{end}_{name}"))
    got = ranked.groupBy(*part).agg(F.max("_total").alias("_total"), *picks)
    return got.select(*part, F.col("_total").alias("n_values"), *[
        (F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (spot - F.floor(spot))).alias(name) for name, spot in spots.items()])


def counted_quantiles(values: DataFrame, buckets: DataFrame, part: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """`quantiles` from counted values: only the values of buckets that hold a wanted rank are ranked."""
    spots = [q * (F.col("_total") - 1).cast("double") for q in qs.values()]
    wanted = buckets.where(reduce(Column.__or__, [_covers(r, F.col("_below"), F.col("_bn")) for s in spots for r in (F.floor(s), F.ceil(s))]))
    return _picked(_ranked(values, wanted, part), part, qs, "_v", "_less")


def quantiles(df: DataFrame, part: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles: one row per partition with a column per entry of `qs`, and `n_values`."""
    return counted_quantiles(*_counted(df, part, value), part, qs)


def median_mad(df: DataFrame, part: Sequence[str], value: str) -> DataFrame:
    """`med` and `mad` (median distance from the median) per partition.

    The rows are counted once. The counts of both sides of the median are merged outwards by bucket: buckets that are
    nearer than the wanted distance as a whole are passed over with their totals, farther ones are left out, and only
    the values of the few buckets in between are ranked by distance.
    """
    values = materialize(value_counts(df, part, value), "value-counts")
    buckets = bucket_totals(values, part)
    med = materialize(counted_quantiles(values, buckets.drop("_lo", "_hi"), part, {"med": 0.5}).select(*part, "med"), "medians")
    m = F.col("med")
    near = F.greatest(F.lit(0.0), F.col("_lo") - m, m - F.col("_hi"))
    far = F.greatest(F.abs(F.col("_lo") - m), F.abs(F.col("_hi") - m))
    placed = join_scope(buckets.drop("_below"), med, part).withColumns({"_near": near, "_far": far})
    # Each bucket starts to count at its near end; at its far end it asks how many rows can be as near, at its near end how many must be nearer.
    marks = F.array(*(F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), n.alias("_add"), d.alias("_done")) for at, kind, n, d in (
        (F.col("_near"), 1, F.col("_bn"), F.lit(0).cast("long")), (F.col("_near"), 0, F.lit(0).cast("long"), F.lit(0).cast("long")),
        (F.col("_far"), 2, F.lit(0).cast("long"), F.lit(0).cast("long")), (F.col("_far"), 3, F.lit(0).cast("long"), F.col("_bn")))))
    line = Window.partitionBy(*part).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = placed.select(*part, "_b", "_bn", "_total", F.inline(marks)).withColumns({"_started": F.sum("_add").over(line), "_ended": F.sum("_done").over(line)})
    asked = walked.groupBy(*part, "_b", "_bn", "_total").agg(F.max(F.when(F.col("_kind") == 0, F.col("_ended"))).alias("_nearer"), F.max(F.when(F.col("_kind") == 2, F.col("_started"))).alias("_as_near"))
    low, high = F.floor(0.5 * (F.col("_total") - 1)), F.ceil(0.5 * (F.col("_total") - 1))
    passed = F.col("_as_near") <= low
    judged = asked.withColumn("_before", F.sum(F.when(passed, F.col("_bn")).otherwise(0)).over(Window.partitionBy(*part))).where(~passed & (F.col("_nearer") <= high))
    dist = join_scope(join_scope(values, judged.select(*part, "_b", "_total", "_before"), [*part, "_b"]), med, part).groupBy(*part, F.abs(F.col("_v") - m).alias("_d")).agg(
        F.sum("_n").alias("_n"), F.max("_total").alias("_total"), F.max("_before").alias("_before"))
    ahead = Window.partitionBy(*part).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dist.withColumn("_less", F.col("_before") + F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    return join_scope(med, _picked(ranked, part, {"mad": 0.5}, "_d", "_less").drop("n_values"), part)


def long_form(df: DataFrame, part: Sequence[str], features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """One row per (row, feature): columns part, ids, feature, value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*part, *ids, F.inline(pairs))


def feature_stats(df: DataFrame, part: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Median and MAD of every feature: part, feature, med, mad."""
    return median_mad(long_form(df, part, features), [*part, "feature"], "value")


def iqr_stats(df: DataFrame, part: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Median and interquartile range of every feature: part, feature, center, iqr."""
    q = quantiles(long_form(df, part, features), [*part, "feature"], "value", {"q1": 0.25, "center": 0.5, "q3": 0.75})
    return q.select(*part, "feature", "center", (F.col("q3") - F.col("q1")).alias("iqr"))


def with_stats(df: DataFrame, part: Sequence[str], stats: DataFrame, names: Sequence[str], out: str = "_stats") -> DataFrame:
    """`df` with a map from feature to the values `names` of long `stats` (part, feature, names).

    One row per partition meets the rows as they are: the rows are neither spread over features nor exchanged by partition
    while the partitions are few.
    """
    per = stats.groupBy(*part).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*names)))).alias(out))
    return join_scope(df, small_side(per), part, "left")


def robust_scale(df: DataFrame, part: Sequence[str], features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(x - median) / IQR in long form; a zero range divides by one."""
    wide = with_stats(df, part, iqr_stats(df, part, features), ("center", "iqr"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col("_stats")[f]["center"].alias("center"), F.col("_stats")[f]["iqr"].alias("iqr")) for f in features])
    return wide.select(*part, *ids, F.inline(cells)).withColumn(
        "scaled", (F.col("value") - F.col("center")) / F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr")))


def hygiene(df: DataFrame, part: Sequence[str], features: Sequence[str], cap: float | None = None) -> DataFrame:
    """Numbers only: unreadable, missing and NaN become 0, +Inf the largest finite value (or `cap`), -Inf 0."""
    num = df.withColumns({f: F.nanvl(F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    inf, ninf = F.lit(float("inf")), F.lit(float("-inf"))
    if cap is None:
        tops = num.groupBy(*part).agg(*[F.max(F.when((F.col(f) != inf) & (F.col(f) != ninf), F.col(f))).alias(f"_top_{f}")
                                        for f in features])
        num = join_scope(num, small_side(tops), part)
        top = {f: F.coalesce(F.col(f"_top_{f}"), F.lit(0.0)) for f in features}
    else:
        top = {f: F.lit(float(cap)) for f in features}
    out = num.withColumns({f: F.when(F.col(f) == inf, top[f]).when(F.col(f) == ninf, 0.0).otherwise(F.col(f)) for f in features})
    return out.drop(*[f"_top_{f}" for f in features])


def scale_0_100(df: DataFrame, part: Sequence[str], value: str, out: str, lo: float, hi: float, flat: str = "zero") -> DataFrame:
    """Map quantile `lo` to 0 and `hi` to 100 and clip; when both are equal: 0, min-max, or percent rank."""
    q = quantiles(df, part, value, {"_qlo": lo, "_qhi": hi, "_qmin": 0.0, "_qmax": 1.0})
    x = join_scope(df, small_side(q.drop("n_values")), part, "left")
    v, a, b = F.col(value), F.col("_qlo"), F.col("_qhi")
    if flat == "minmax":
        span = F.col("_qmax") - F.col("_qmin")
        instead = F.when(span > 0, (v - F.col("_qmin")) / F.nullif(span, F.lit(0.0)) * 100.0).otherwise(F.lit(0.0))
    elif flat == "rank":
        x = percent_rank(x, part, value, "_rank")
        instead = F.col("_rank")
    else:
        instead = F.lit(0.0)
    scaled = F.when(b - a > (1e-9 if flat == "rank" else 0.0), (v - a) / F.nullif(b - a, F.lit(0.0)) * 100.0).otherwise(instead)
    return (x.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled)))
            .drop("_qlo", "_qhi", "_qmin", "_qmax", "_rank"))


def top_k(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows of every partition; each task keeps at most k rows before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)

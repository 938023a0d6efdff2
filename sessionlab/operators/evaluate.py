"""Comparing rankings: precision, agreement, drift, stability, cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SESSION_KEYS, keys_of
from .stats import quantiles, top_k

WEAK_POSITIVES = ("error", "rate_limited", "blocked")
POSITIVE_LABELS = ("suspicious", "needs_review")
KS = (50, 100, 200, 500, 1000)


def weak_label(outcomes: Column, positives: Sequence[str] = WEAK_POSITIVES) -> Column:
    """1 when any element, trimmed and in lower case, is a positive outcome; null arrays give 0."""
    hit = F.exists(outcomes, lambda o: F.coalesce(F.lower(F.trim(o)).isin(list(positives)), F.lit(False)))
    return F.coalesce(hit, F.lit(False)).cast("int")


def weak_labels(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, positives: Sequence[str] = WEAK_POSITIVES) -> DataFrame:
    """The same per session, from event rows."""
    keys = keys_of(keys, events)
    hit = F.lower(F.trim("outcome_class")).isin(list(positives))
    return events.groupBy(*keys).agg(F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("label"))


def precision_at_k(scores: DataFrame, labels: DataFrame, score_cols: Sequence[str], ks: Sequence[int] = KS,
                   keys: Sequence[str] = SESSION_KEYS, part: Sequence[str] = ()) -> DataFrame:
    """Share of labelled positives among the k highest, for every score and k in one job; k is capped at n."""
    keys = keys_of(keys, scores, labels)
    j = scores.join(labels.select(*keys, "label"), list(keys), "left").withColumn("label", F.coalesce("label", F.lit(0)))
    cells = F.array(*[F.struct(F.lit(c).alias("score_col"), F.col(c).cast("double").alias("score")) for c in score_cols])
    long = j.select(*keys, "label", F.inline(cells))
    by = [*part, "score_col"]
    sizes = long.groupBy(*by).agg(F.count("*").alias("n_scored"), F.sum("label").alias("n_pos_total"))
    best = top_k(long, by, [F.desc_nulls_last("score"), *[F.asc(k) for k in keys]], max(ks), "_r")
    hits = best.groupBy(*by).agg(*[F.sum(F.when(F.col("_r") <= k, F.col("label")).otherwise(0)).alias(f"h{k}") for k in ks])
    out = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    return sizes.join(hits, by).select(*by, "n_scored", "n_pos_total", F.inline(out)).withColumn(
        "precision_at_k", F.col("hits") / F.least("k", "n_scored"))


def relaxed_precision(ranked: DataFrame, review: DataFrame, k: int, keys: Sequence[str], part: Sequence[str]) -> DataFrame:
    """Share of `suspicious` or `needs_review` among ranks 1..k, divided by k."""
    hit = F.when(F.col("label").isin(*POSITIVE_LABELS), 1).otherwise(0)
    return (ranked.where(F.col("rank") <= k).join(review.select(*keys, "label"), list(keys), "left")
            .groupBy(*part).agg((F.sum(hit) / F.lit(k)).alias("precision_at_k_relaxed"), F.count("label").alias("reviewed")))


def consistency(first: DataFrame, second: DataFrame, k: int, keys: Sequence[str], part: Sequence[str]) -> DataFrame:
    """Share of the k reviewed sessions that got the same label twice."""
    a = first.where(F.col("rank") <= k).select(*dict.fromkeys([*part, *keys]), F.col("label").alias("a"))
    same = F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    return (a.join(second.select(*keys, F.col("label").alias("b")), list(keys)).groupBy(*part)
            .agg((F.sum(same) / F.lit(k)).alias("consistency_at_k")))


def _members(top: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    return top.select(*keys).distinct().withColumn(flag, F.lit(1))


def overlap(a: DataFrame, b: DataFrame, k: int, keys: Sequence[str] = SESSION_KEYS, part: Sequence[str] = ()) -> DataFrame:
    """Common sessions of two top lists: count, share of k, and Jaccard index."""
    keys = keys_of(keys, a, b)
    both = _members(a, keys, "_a").join(_members(b, keys, "_b"), list(keys), "full")
    common = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.groupBy(*part).agg(common.alias("common"), (common / F.lit(k)).alias("overlap"),
                                   (common / F.count("*")).alias("jaccard"))


def drift(scores: DataFrame, value: str, period: str, part: Sequence[str] = ("client_name",)) -> DataFrame:
    """Score distribution per period and its shift from the period before."""
    by = [*part, period]
    moments = scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    d = moments.join(quantiles(scores, by, value, {"p50": 0.50, "p95": 0.95}), by)
    w = Window.partitionBy(*part).orderBy(period)
    return d.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in ("mean", "std", "p50", "p95")})


def stability(top: DataFrame, period: str, k: int, entity: Sequence[str] = ("client_name", "user_id"),
              part: Sequence[str] = ("client_name",)) -> DataFrame:
    """Share of each period's top k that is among the next period's: by user, since session keys do not persist."""
    keys = list(dict.fromkeys([*part, *entity]))
    periods = top.select(*part, period).distinct().withColumn("_next", F.lead(period).over(Window.partitionBy(*part).orderBy(period)))
    now = top.select(*keys, period).distinct().join(periods, [*part, period])
    then = top.select(*keys, F.col(period).alias("_next"), F.lit(1).alias("_hit")).distinct()
    return (now.where(F.col("_next").isNotNull()).join(then, [*keys, "_next"], "left")
            .groupBy(*part, period, F.col("_next").alias("next_period"))
            .agg(F.count("_hit").alias("common"), (F.count("_hit") / F.lit(k)).alias("stability")))


def gain(base: DataFrame, other: DataFrame, by: Sequence[str] = ("k",)) -> DataFrame:
    """Difference of precision between two runs."""
    b = base.select(*by, F.col("precision_at_k").alias("base"))
    return other.select(*by, F.col("precision_at_k").alias("other")).join(b, list(by)).withColumn("gain", F.col("other") - F.col("base"))


def seed_sensitivity(tops: DataFrame, precisions: DataFrame, model: str = "model", seed: str = "seed",
                     keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Spread of precision over seeds and mean Jaccard index of the seeds' top lists. Inputs are top-k lists."""
    keys = keys_of(keys, tops, precisions)
    spread = precisions.groupBy(model, "k").agg(F.stddev_pop("precision_at_k").alias("precision_std"),
                                                F.count("*").alias("runs"))
    lists = tops.select(model, seed, *keys).distinct()
    sizes = lists.groupBy(model, seed).agg(F.count("*").alias("n"))
    other = lists.select(model, F.col(seed).alias("_seed2"), *keys)
    pairs = lists.join(other, [model, *keys]).where(F.col(seed) < F.col("_seed2")).groupBy(model, seed, "_seed2").agg(F.count("*").alias("c"))
    seeds = sizes.join(sizes.select(model, F.col(seed).alias("_seed2"), F.col("n").alias("n2")), model).where(F.col(seed) < F.col("_seed2"))
    j = seeds.join(pairs, [model, seed, "_seed2"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    mean = j.groupBy(model).agg(F.avg(F.col("c") / (F.col("n") + F.col("n2") - F.col("c"))).alias("mean_jaccard"))
    return spread.join(mean, model, "left")


def costs(runs: DataFrame, model: str = "model", part: Sequence[str] = ("dataset",)) -> DataFrame:
    """Seconds and rows per model, with the cost relative to the cheapest model of the data set."""
    per = runs.groupBy(*part, model).agg(F.sum("seconds").alias("seconds"), F.max("rows").alias("rows"))
    least = F.min("seconds").over(Window.partitionBy(*part))
    return per.withColumn("relative_cost", F.col("seconds") / least).withColumn("rows_per_s", F.col("rows") / F.col("seconds"))


def report(metrics: dict[str, DataFrame]) -> DataFrame:
    """One long table (metric, detail, value): each input's last numeric column is its value, the rest its detail."""
    parts = None
    for name, df in metrics.items():
        *rest, value = df.columns
        row = df.select(F.lit(name).alias("metric"), F.to_json(F.struct(*rest) if rest else F.struct(F.lit(name).alias("metric"))).alias("detail"),
                        F.col(value).cast("double").alias("value"))
        parts = row if parts is None else parts.unionByName(row)
    return parts

"""Which features set a session apart from its scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .stats import feature_stats, with_stats


def deviations(df: DataFrame, scope: Sequence[str], keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form: value, median, MAD and robust z (null where the MAD is 0) of every feature of every row."""
    wide = with_stats(df, scope, feature_stats(df, scope, features), ("med", "mad"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col("_stats")[f]["med"].alias("med"), F.col("_stats")[f]["mad"].alias("mad")) for f in features])
    z = (F.col("value") - F.col("med")) / F.nullif(F.col("mad"), F.lit(0.0))
    return wide.select(*dict.fromkeys([*scope, *keys]), F.inline(cells)).withColumn("z", z)


def robust_z_score(df: DataFrame, scope: Sequence[str], keys: Sequence[str], features: Sequence[str], floor: float = 1e-9) -> DataFrame:
    """Baseline score of every row: largest and mean absolute robust z over the features it has."""
    wide = with_stats(df, scope, feature_stats(df, scope, features), ("med", "mad"))
    cells = []
    for f in features:
        s = F.col("_stats")[f]
        cells.append(F.abs(F.col(f).cast("double") - s["med"]) / F.when(s["mad"] == 0, floor).otherwise(s["mad"]))
    az = F.array_compact(F.array(*cells))
    mean = F.aggregate(az, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(az), F.lit(0))
    return wide.select(*dict.fromkeys([*scope, *keys]), F.array_max(az).alias("z_max"), mean.alias("z_mean"))


def _line(name: str, value: Column, med: Column, mad: Column) -> Column:
    """Sortable struct: rare non-zero features first in column order, then by distance; `text` explains."""
    rare = (med == 0) & (mad == 0) & (value != 0)
    z = (value - med) / F.nullif(mad, F.lit(0.0))
    head = F.concat(F.lit(f"{name}="), C.fixed(value))
    plain = F.concat(head, F.lit(" (med="), C.fixed(med))
    text = (F.when(rare, F.concat(head, F.lit(" (rare_nonzero)")))
            .when(z.isNull(), F.concat(plain, F.lit(")")))
            .otherwise(F.concat(plain, F.lit(", z="), C.signed(z), F.lit(")"))))
    return F.when(rare, 0).otherwise(1), F.when(rare, 0.0).otherwise(-F.abs(F.coalesce(z, F.lit(0.0)))), text


def why_top(df: DataFrame, scope: Sequence[str], features: Sequence[str], n: int = 5, out: str = "why_top5",
            stats_of: DataFrame | None = None) -> DataFrame:
    """Text naming the n most telling features of each row; `stats_of` are the rows to compare with."""
    stats = feature_stats(stats_of if stats_of is not None else df, scope, features)
    cells = []
    for i, f in enumerate(features):
        group, far, text = _line(f, F.col(f).cast("double"), F.col("_s")[f]["med"], F.col("_s")[f]["mad"])
        cells.append(F.struct(group.alias("g"), far.alias("d"), F.lit(i).alias("i"), text.alias("t")))
    best = F.slice(F.array_sort(F.array(*cells)), 1, n)
    return with_stats(df, scope, stats, ("med", "mad"), "_s").withColumn(
        out, F.array_join(F.transform(best, lambda c: c.t), "; ")).drop("_s")

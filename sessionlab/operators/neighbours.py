"""Local outlier factor by one rule at every size.

Comparing every pair of rows does not scale. Rows are ranked exactly along several fixed directions; a run of `BLOCK`
consecutive ranks, with a margin of its neighbours' ranks, is compared within itself, and of all runs a row was in, the
`k` nearest rows found are its neighbours. Reachability and density follow from two joins over the neighbours. In scopes
of `BLOCK` rows or fewer one run holds all rows, so the result is the plain local outlier factor; beyond, neighbours are missed only
where no direction brings them near.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import join_scope, materialize
from .stats import grid_bucket, iqr_stats, top_k, with_stats

BLOCK = 1024


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(sq, 0.0))


def local_outlier_factors(x: np.ndarray, ids: np.ndarray, ref: np.ndarray, ref_ids: np.ndarray, k: int) -> np.ndarray:
    """The factor of each row of x among all of `ref`, pair by pair: what `lof` gives for one run. A row that is itself in `ref` is not its own neighbour."""
    center = np.median(ref, axis=0)
    q1, q3 = np.percentile(ref, [25, 75], axis=0)
    width = np.where(q3 > q1, q3 - q1, 1.0)
    x, ref = (x - center) / width, (ref - center) / width
    k = min(k, len(ref) - 1)
    if k < 1:
        return np.ones(len(x))
    inner = _distances(ref, ref)
    np.fill_diagonal(inner, np.inf)
    near = np.argsort(inner, axis=1, kind="stable")[:, :k]
    k_dist = np.take_along_axis(inner, near, 1)[:, -1]

    def density(dist: np.ndarray, idx: np.ndarray) -> np.ndarray:
        reach = np.maximum(np.take_along_axis(dist, idx, 1), k_dist[idx])
        return 1.0 / (reach.mean(axis=1) + 1e-10)

    ref_density = density(inner, near)
    out = np.empty(len(x))
    for i in range(0, len(x), BLOCK):
        dist = _distances(x[i:i + BLOCK], ref)
        dist[ids[i:i + BLOCK, None] == ref_ids[None, :]] = np.inf
        idx = np.argsort(dist, axis=1, kind="stable")[:, :k]
        out[i:i + BLOCK] = ref_density[idx].mean(axis=1) / density(dist, idx)
    return out


PROJECTIONS = 12
RUN = 1024
MARGIN = 128
HOT_BUCKET = 50_000


def directions(dims: int, n: int, seed: int) -> np.ndarray:
    d = np.random.default_rng(seed).normal(size=(n, dims))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def ranked(spots: DataFrame, part: Sequence[str]) -> DataFrame:
    """`spots` (part, id, v) with `rank`, the place by v, and `_total`, the rows of `part`.

    Rows of one bucket of the value grid are ranked by themselves; a bucket with very many rows, whose values are alike to
    four digits, is cut by hash first.
    """
    cut = spots.withColumn("_b", grid_bucket(F.col("v")))
    sizes = cut.groupBy(*part, "_b").agg(F.count("*").alias("_n")).withColumn("_cuts", F.ceil(F.col("_n") / HOT_BUCKET))
    whole = Window.partitionBy(*part)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(whole)})
    cut = join_scope(cut, sizes.drop("_n"), [*part, "_b"]).withColumn("_cut", F.when(F.col("_cuts") > 1, F.pmod(F.xxhash64("id"), F.col("_cuts"))).otherwise(F.lit(0).cast("long")))
    inner = cut.groupBy(*part, "_b", "_cut").agg(F.count("*").alias("_n"))
    inner = inner.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy(*part, "_b").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    line = F.row_number().over(Window.partitionBy(*part, "_b", "_cut").orderBy("v", "id")) - 1
    return join_scope(cut, inner, [*part, "_b", "_cut"]).withColumn("rank", F.col("_before") + F.col("_ahead") + line).drop("_b", "_cut", "_cuts", "_before", "_ahead")


def nearest(x: DataFrame, scope: Sequence[str], dims: int, k: int, projections: int = PROJECTIONS, run: int = RUN, margin: int = MARGIN, seed: int = 42) -> DataFrame:
    """(id, near, dist): the k nearest rows found of each row of `x` (scope, id, x: array<double>); ties by id."""
    place = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, d.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for d in directions(dims, projections, seed)]
    spots = x.select(*scope, "id", "x", F.posexplode(F.array(*place)).alias("p", "v"))
    placed = ranked(spots, [*scope, "p"])
    placed = placed.where((F.col("p") == 0) | (F.col("_total") > run))     # one run of all rows needs one direction
    home, at = F.floor(F.col("rank") / run), F.col("rank") % run
    many = F.col("_total") > run
    homes = F.array_compact(F.array(home, F.when(many & (at < margin) & (home > 0), home - 1), F.when(many & (at >= run - margin), home + 1)))
    dealt = placed.select(*scope, "p", "id", "x", home.alias("home"), F.explode(homes).alias("run"))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").combine_chunks()
        m = np.array(table.column("x").to_pylist(), dtype=float).reshape(len(ids), dims)
        own = np.flatnonzero(table.column("home").to_numpy() == table.column("run").to_numpy())
        n = min(k, len(ids) - 1)
        left, right, dist = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
        for i in range(0, len(own) if n > 0 else 0, 64):
            rows = own[i:i + 64]
            d = np.round(np.sqrt(((m[rows, None, :] - m[None, :, :]) ** 2).sum(-1)), 9)
            d[np.arange(len(rows)), rows] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :n]
            left.append(np.repeat(rows, n))
            right.append(best.ravel())
            dist.append(np.take_along_axis(d, best, 1).ravel())
        return pa.table({"id": ids.take(pa.array(np.concatenate(left))), "near": ids.take(pa.array(np.concatenate(right))), "dist": np.concatenate(dist)})
    found = dealt.groupBy(*scope, "p", "run").applyInArrow(search, "id string, near string, dist double")
    found = found.groupBy("id", "near").agg(F.min("dist").alias("dist"))
    return top_k(found, ["id"], [F.asc("dist"), F.asc("near")], k, "place").drop("place")


def lof(features: DataFrame, scope: Sequence[str], keys: Sequence[str], columns: Sequence[str], k: int = 20,
        projections: int = PROJECTIONS, run: int = RUN, margin: int = MARGIN, seed: int = 42) -> DataFrame:
    """`features` with `lof`, about 1 where a row is as dense as its neighbours and larger where it is not; a row alone in its scope has 1.

    Features are centred on the median and divided by the interquartile range of the scope (by 1 where that is 0).
    """
    columns = list(columns)
    name = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in dict.fromkeys([*scope, *keys])]))
    staged = materialize(features.withColumn("_id", name), "features")
    wide = with_stats(staged, scope, iqr_stats(staged, scope, columns), ("center", "iqr"))

    def scaled(c: str):
        s = F.col("_stats")[c]
        return F.coalesce((F.col(c).cast("double") - s["center"]) / F.when(s["iqr"] > 0, s["iqr"]).otherwise(1.0), F.lit(0.0))
    x = materialize(wide.select(*scope, F.col("_id").alias("id"), F.array(*map(scaled, columns)).alias("x")), "vectors")
    near = materialize(nearest(x, scope, len(columns), k, projections, run, margin, seed), "neighbours")
    reach = near.groupBy(F.col("id").alias("_of")).agg(F.max("dist").alias("_far"))
    dense = near.join(reach, F.col("near") == F.col("_of")).groupBy("id").agg((1.0 / (F.avg(F.greatest("dist", "_far")) + 1e-10)).alias("density"))
    dense = materialize(dense, "densities")
    around = near.join(dense.select(F.col("id").alias("_of"), F.col("density").alias("_theirs")), F.col("near") == F.col("_of")).groupBy("id").agg(F.avg("_theirs").alias("_theirs"))
    factors = around.join(dense, "id").select(F.col("id").alias("_of"), (F.col("_theirs") / F.col("density")).alias("_lof"))
    return staged.join(factors, F.col("_id") == F.col("_of"), "left").withColumn("lof", F.coalesce("_lof", F.lit(1.0))).drop("_id", "_of", "_lof")

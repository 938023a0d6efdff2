"""Isolation forest: trees grown from bounded hash-drawn samples, rows scored chunk by chunk."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..profiles import IMPL, Profile
from ..staging import materialize
from .models import draw_samples, scope_sizes, score_in_chunks
from .stats import hygiene, percent_rank, scale_0_100

BATCH = 25          # trees grown together in one call
ROWS = 4096         # rows walked down a batch of trees at a time
NODE_COLUMNS = ("batch int, trees int, psi int, feature array<int>, threshold array<double>, "
                "left array<int>, right array<int>, depth array<double>")


def expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    many = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def grow_trees(x: np.ndarray, tree: np.ndarray, trees: int, limit: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Grow all trees of a batch level by level; nodes 0..trees-1 are the roots, a leaf has feature -1.

    `tree` says which tree a row of `x` belongs to. `depth` of a leaf includes the depth still expected
    for the rows left in it.
    """
    levels, first = [], 0
    node = tree.astype(np.int64)
    width = trees
    for depth in range(limit + 1):
        order = np.argsort(node, kind="stable")
        x, node = x[order], node[order]
        present, starts, sizes = np.unique(node, return_index=True, return_counts=True)
        lo, hi = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
        varying = hi > lo
        splits = varying.any(axis=1) & (sizes > 1) & (depth < limit)
        pick = np.where(varying, rng.random(varying.shape), -1.0).argmax(axis=1)
        at = np.arange(len(present))
        low, high = lo[at, pick], hi[at, pick]
        cut = np.minimum(low + rng.random(len(present)) * (high - low), np.nextafter(high, -np.inf))
        child = first + width + 2 * (np.cumsum(splits) - 1)
        level = {"feature": np.full(width, -1), "threshold": np.zeros(width), "left": np.full(width, -1),
                 "right": np.full(width, -1), "depth": np.full(width, float(depth))}
        here = present - first
        level["feature"][here[splits]] = pick[splits]
        level["threshold"][here[splits]] = cut[splits]
        level["left"][here[splits]], level["right"][here[splits]] = child[splits], child[splits] + 1
        level["depth"][here] = depth + expected_depth(sizes)
        levels.append(level)
        if not splits.any():
            break
        group = np.repeat(at, sizes)
        goes_right = x[np.arange(len(x)), pick[group]] > cut[group]
        keep = splits[group]
        node = (child[group] + goes_right)[keep]
        x = x[keep]
        first, width = first + width, 2 * int(splits.sum())
    return {name: np.concatenate([lv[name] for lv in levels]) for name in levels[0]}


def walk(x: np.ndarray, nodes: dict[str, np.ndarray], trees: int) -> np.ndarray:
    """Sum over the trees of a batch of the depth at which each row ends."""
    total = np.empty(len(x))
    for i in range(0, len(x), ROWS):
        part = x[i:i + ROWS]
        rows = np.arange(len(part))[:, None]
        at = np.tile(np.arange(trees), (len(part), 1))
        while True:
            f = nodes["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            goes_left = part[rows, np.maximum(f, 0)] <= nodes["threshold"][at]
            at = np.where(inner, np.where(goes_left, nodes["left"][at], nodes["right"][at]), at)
        total[i:i + ROWS] = nodes["depth"][at].sum(axis=1)
    return total


def grow_forest(features: DataFrame, scope: Sequence[str], keys: Sequence[str], columns: Sequence[str],
                trees: int, sample: int = 256, seed: int = 42, sizes: DataFrame | None = None) -> DataFrame:
    """The trees of every scope, a batch of them per row."""
    scope = list(scope)
    x = features.select(*scope, *keys_apart(keys, scope), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    drawn = draw_samples(x, scope, keys, sample, trees, seed, sizes).withColumn("batch", (F.col("draw") / BATCH).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "_place"])
        batch = int(pdf["batch"].iloc[0])
        name = "\x1f".join(str(pdf[c].iloc[0]) for c in scope)
        rng = np.random.default_rng([zlib.crc32(name.encode()), batch, seed])
        tree = np.unique(pdf["draw"].to_numpy(), return_inverse=True)[1]
        psi, n = int(np.bincount(tree).max()), int(tree.max()) + 1
        nodes = grow_trees(np.stack(pdf["_x"].to_numpy()), tree, n, int(np.ceil(np.log2(max(psi, 2)))), rng)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in scope}, "batch": batch, "trees": n, "psi": psi, **nodes}])

    head = ", ".join(f"{c} {features.schema[c].dataType.simpleString()}" for c in scope)
    return (drawn.select(*scope, "batch", "draw", "_place", "_x").groupBy(*scope, "batch")
            .applyInPandas(grow, f"{head}, {NODE_COLUMNS}"))


def keys_apart(keys: Sequence[str], scope: Sequence[str]) -> list[str]:
    return [k for k in keys if k not in scope]


def matrix(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows.column(c).cast(pa.float64()).fill_null(0.0).to_numpy() for c in columns])


def score_forest(features: DataFrame, forest: DataFrame, scope: Sequence[str], keys: Sequence[str],
                 columns: Sequence[str], out: str = "if_raw", sizes: DataFrame | None = None) -> DataFrame:
    """Append 2^(-mean depth / expected depth): near 1 for rows that are cut off early."""
    columns = list(columns)
    names = ["feature", "threshold", "left", "right", "depth"]

    def score(rows: pa.Table, fitted: pa.Table) -> dict[str, pa.Array]:
        x = matrix(rows, columns)
        total, used, psi = np.zeros(len(x)), 0, 0
        for b in sorted(fitted.select(["batch", "trees", "psi", *names]).to_pylist(), key=lambda r: r["batch"]):
            total += walk(x, {n: np.array(b[n]) for n in names}, b["trees"])
            used, psi = used + b["trees"], max(psi, b["psi"])
        norm = float(expected_depth(psi))
        if norm <= 0:  # a row alone in its scope is neither near nor far
            return {out: pa.array(np.full(len(x), 0.5))}
        return {out: pa.array(np.power(2.0, -(total / max(used, 1)) / norm))}

    return score_in_chunks(features, forest, scope, keys, score, T.StructType([T.StructField(out, T.DoubleType())]), sizes=sizes)


def rank_by_forest(features: DataFrame, scope: Sequence[str] = ("day",), keys: Sequence[str] = (), profile: Profile = IMPL,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Fit and score in one go: `if_raw`, `anomaly_score`, `risk_score` (or `risk_score_if`) and `risk_pct`.

    The features are written once and then read for cleaning, counting, drawing and scoring.
    """
    columns = columns or profile.features
    clean = hygiene(materialize(features, "features"), scope, columns)
    sizes = scope_sizes(clean, scope)
    forest = grow_forest(clean, scope, keys, columns, profile.trees, profile.sample, profile.seed, sizes)
    scored = materialize(score_forest(clean, forest, scope, keys, columns, sizes=sizes), "scores")
    scored = scored.withColumn("anomaly_score", F.col("if_raw") - 0.5)
    name, flat = ("risk_score", "rank") if profile.name == "impl" else ("risk_score_if", "zero")
    return percent_rank(scale_0_100(scored, scope, "if_raw", name, *profile.scale, flat), scope, "if_raw", "risk_pct")

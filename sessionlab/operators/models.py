"""Plumbing for models that are small per scope while the rows to score are many.

A model is fitted on a bounded sample per scope and kept as rows of a DataFrame. For scoring, the rows of a
scope are cut into chunks of bounded size and each chunk meets a copy of its scope's model in one task, so
neither a hot scope nor a large set of models gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import join_scope, small_side

CHUNK_ROWS = 50_000
_SPACE = 2 ** 50


def scope_sizes(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows per scope, ready to be joined to the rows without moving them."""
    return small_side(df.groupBy(*scope).agg(F.count("*").alias("_n")))


def draw_samples(df: DataFrame, scope: Sequence[str], keys: Sequence[str], size: int, draws: int = 1, seed: int = 42,
                 sizes: DataFrame | None = None) -> DataFrame:
    """`draws` samples of at most `size` rows per scope: the input rows with a column `draw`.

    A row needs to be in each draw with probability `rate`. The draws are cut into stretches of 1/rate of them, rounded
    down; a row gets one ticket per stretch, which falls on one of its draws or beyond its end. So no row is twice in a
    draw. Then the lowest hashes of each draw stay. Row order and partitioning do not matter.
    """
    rate = F.least(F.lit(1.0), F.lit(1.3 * size) / F.col("_n"))
    sized = join_scope(df, sizes if sizes is not None else scope_sizes(df, scope), scope).withColumn("_rate", rate).withColumn(
        "_stretch", F.least(F.floor(1 / F.col("_rate")), F.lit(draws)).cast("int")).withColumn("_tickets", F.ceil(F.lit(draws) / F.col("_stretch")).cast("int"))

    def spot(i):
        u = F.pmod(F.xxhash64(*keys, i, F.lit(seed)), F.lit(_SPACE)) / float(_SPACE)
        return F.struct((i * F.col("_stretch") + u / F.col("_rate")).alias("at"), F.least((i + 1) * F.col("_stretch"), F.lit(draws)).alias("end"))

    spots = F.transform(F.sequence(F.lit(0), F.col("_tickets") - 1), spot)
    rows = (sized.withColumn("_spot", F.explode(spots)).where("_spot.at < _spot.end").withColumn("draw", F.floor("_spot.at").cast("int"))
            .withColumn("_ticket", F.xxhash64(*keys, "draw", F.lit(seed + 1))))
    w = Window.partitionBy(*scope, "draw").orderBy("_ticket", *keys)
    return (rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= size)
            .drop("_n", "_rate", "_stretch", "_tickets", "_spot", "_ticket"))


def score_in_chunks(df: DataFrame, model: DataFrame, scope: Sequence[str], keys: Sequence[str],
                    score: Callable[[pa.Table, pa.Table], dict[str, pa.Array]], added: T.StructType,
                    chunk_rows: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Append the columns `score(rows, model_rows)` computes to every row of `df`."""
    sizes = (sizes if sizes is not None else scope_sizes(df, scope)).select(
        *scope, F.ceil(F.col("_n") / (chunk_rows or CHUNK_ROWS)).cast("int").alias("_chunks"))
    left = join_scope(df, sizes, scope).withColumn(
        "_chunk", F.pmod(F.xxhash64(*keys), F.col("_chunks").cast("long")).cast("int")).drop("_chunks")
    # Fresh column identities: the model may have been fitted on `df` itself.
    right = join_scope(model, sizes, scope).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    names = df.columns

    def run(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        out = rows.select(names)
        # Arrow hands timestamps over in the session's zone and wants them back in UTC.
        out = out.cast(pa.schema([
            pa.field(f.name, pa.timestamp("us", tz="UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f
            for f in out.schema]))
        for name, values in score(rows, fitted).items():
            out = out.append_column(name, values)
        return out

    by = [*scope, "_chunk"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, T.StructType(df.schema.fields + added.fields))

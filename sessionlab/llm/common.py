"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import materialize

ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

# A word of the contracts: a run without ASCII white space. The same six characters are what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


# Rows of one Arrow batch. Spark also ends a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch), which bounds very long texts.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session set to batches of `BATCH_ROWS`: a batch is held several times over, by the JVM, by Arrow and as Python objects."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(fields: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (f.split() for f in fields.split(","))])


def map_columns(df: DataFrame, fn: Callable[..., Iterable[list]], fields: str) -> DataFrame:
    """Batches of `df` through `fn`, which gets one Python list per column and returns one list (or array) per field."""
    shape = schema_of(fields)

    def run(batches):
        for batch in batches:
            out = fn(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, shape)], schema=shape)

    return small_batches(df).mapInArrow(run, fields)


def text_key(col: str) -> list[Column]:
    """128 bits that tell texts apart, as t1 and t2. With the id they are the key of a row; equal rows share it."""
    return [F.xxhash64(F.col(col)).alias("t1"), F.xxhash64(F.lit(7), F.length(col), F.col(col)).alias("t2")]


def before(df: DataFrame, keys: Sequence[str], group: str, order: Sequence, values: dict[str, str], xor: bool = False) -> DataFrame:
    """Add for each `name: column` of `values` the sum (or exclusive-or) of the column over the earlier rows of `keys`.

    Rows are ordered by `group`, then by `order`. One window runs over the groups' totals, another inside each group.
    """
    combine = F.bit_xor if xor else F.sum
    zero = F.lit(0).cast("long")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, group).agg(*(combine(c).alias(f"_t_{n}") for n, c in values.items()))
    starts = totals.select(*(F.col(k).alias(f"_k_{k}") for k in (*keys, group)), *(
        F.coalesce(combine(f"_t_{n}").over(ahead(Window.partitionBy(*keys).orderBy(group))), zero).alias(f"_b_{n}") for n in values))
    met = df.join(starts, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, group)]))
    inside = ahead(Window.partitionBy(*keys, group).orderBy(*order))
    for n, c in values.items():
        own = F.coalesce(combine(c).over(inside), zero)
        met = met.withColumn(n, F.col(f"_b_{n}").bitwiseXOR(own) if xor else F.col(f"_b_{n}") + own)
    return met.drop(*(f"_k_{k}" for k in (*keys, group)), *(f"_b_{n}" for n in values))


def repeated(df: DataFrame, count: str, out: str) -> DataFrame:
    """Each row `count` times, numbered from 0 as `out`; spread in two steps, so that no array holds more than 4096 numbers or blocks of them."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col(count) - 1, 12))))
    numbers = F.sequence(F.col("_block") * 4096, F.least(F.col(count), (F.col("_block") + 1) * 4096) - 1)
    return blocks.withColumn(out, F.explode(numbers)).drop("_block", count)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long): each node with the smallest node it reaches, as (node, root).

    Large-star and small-star steps (Kiveris et al., 2014), each a minimum per node and a join, until every node has one
    edge to a root. Every step is written to the shared folder, so lineage stays short and nothing passes the driver. A node
    with very many edges is one key of a plain join, which adaptive execution splits.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        now = materialize(small.where("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Whether each upper node has one edge and is no other's lower node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()

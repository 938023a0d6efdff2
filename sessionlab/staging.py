"""Write a DataFrame once to the shared checkpoint folder and go on from the written copy.

Used where one costly table feeds several branches: the branches then read the files instead of
repeating its joins, and a lost executor costs no more than a re-read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; a temporary one only in local mode without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="sessionlab-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_scope(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on columns in which null is a value like any other, so rows without a scope keep their own."""
    named = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return left.join(named, test, how).drop(*(f"_of_{c}" for c in on))


def hot_join(left: DataFrame, right: DataFrame, on, hot: DataFrame) -> DataFrame:
    """Left join to `right`, which has one row per key `on`; rows of the keys listed in `hot` meet it on a map side.

    The listed keys go round the shuffle: a key that holds a share of all rows of `left` would be one partition of a merge
    join. Their rows, with or without a partner, are spread over the merge join's partitions under numbers that match nothing.
    """
    on = list(on)
    values = [c for c in right.columns if c not in on]
    near = small_side(join_scope(hot.select(*on).distinct(), right, on, "left").withColumn("_hot", F.lit(1))).withColumnsRenamed({c: f"_near_{c}" for c in values})
    met = join_scope(left, near, on, "left")
    spread = F.when(F.col("_hot") == 1, F.xxhash64(*left.columns).bitwiseAND(F.lit(0xFFFF)) + 1).otherwise(F.lit(0).cast("long"))
    far = right.withColumnsRenamed({c: f"_far_{c}" for c in values}).withColumn("_spread", F.lit(0).cast("long"))
    both = join_scope(met.withColumn("_spread", spread), far, [*on, "_spread"], "left")
    return both.select(*left.columns, *(F.coalesce(f"_near_{c}", f"_far_{c}").alias(c) for c in values))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table expected to be small as a join side: staged, counted, and broadcast only within `limit`.

    Beyond the limit it stays an ordinary join side, which is then sorted and merged.
    """
    staged = materialize(df, "small")
    return F.broadcast(staged) if staged.limit(limit + 1).count() <= limit else staged

"""Ordered work inside sessions of any length.

A window over a whole session puts that session in one task. The helpers here cut a session into
blocks or time slots first, so that the largest group is a slot, and carry what crosses a border
in a table with one row per slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros_bucket
from ..staging import join_scope, materialize, small_side

BLOCK = 8192
SLOT_US = 60_000_000
PART_ROWS = 100_000


def neighbours(df: DataFrame, keys: Sequence[str], seq: str, ahead: dict[str, tuple[str, int]] | None = None,
               behind: dict[str, tuple[str, int]] | None = None, block: int = BLOCK) -> DataFrame:
    """Add columns holding a value `n` rows later (`ahead`) or earlier (`behind`) in the session.

    `seq` numbers the rows of a session 0, 1, 2, ... A row near a block border is copied to the next
    block, so a window per (session, block) sees every neighbour and no window sees a whole session.
    """
    ahead, behind = ahead or {}, behind or {}
    n_ahead = max([n for _, n in ahead.values()], default=0)
    n_behind = max([n for _, n in behind.values()], default=0)
    if max(n_ahead, n_behind) >= block:
        raise ValueError("block must be larger than the widest offset")
    own = ((F.col(seq) - F.col(seq) % block) / block).cast("long")
    pos = F.col(seq) % block
    homes = [own]
    if n_ahead:
        homes.append(F.when((pos < n_ahead) & (own > 0), own - 1))
    if n_behind:
        homes.append(F.when(pos >= block - n_behind, own + 1))
    out = df.withColumn("_own", own).withColumn("_blk", F.explode(F.array_compact(F.array(*homes))))
    w = Window.partitionBy(*keys, "_blk").orderBy(seq)
    out = out.withColumns({name: F.lead(c, n).over(w) for name, (c, n) in ahead.items()}
                          | {name: F.lag(c, n).over(w) for name, (c, n) in behind.items()})
    return out.where(F.col("_own") == F.col("_blk")).drop("_own", "_blk")


def number_rows(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], out: str = "seq_no",
                slot_us: int = SLOT_US) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... by (time, ties); rows without a time come last."""
    df = df.withColumn("_slot", F.coalesce(micros_bucket(F.col(time), slot_us), F.lit(2**62)))
    w = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
               .select(*keys, "_slot", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")))
    inside = Window.partitionBy(*keys, "_slot").orderBy(F.col(time).asc_nulls_last(), *ties)
    return (df.join(offsets, [*keys, "_slot"])
            .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("long"))
            .drop("_slot", "_off"))


def number_untimed(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], out: str = "seq_no",
                   slot_us: int = SLOT_US, part_rows: int = PART_ROWS) -> DataFrame:
    """`number_rows` for tables in which many rows may have no time.

    Rows without a time have no slots. They are dealt into partitions by ranges of (key, tie columns), which keep that order,
    written once, and counted by partition: each partition's rows are then numbered by themselves from the count before them.
    """
    df = materialize(df, "to-number")
    untimed = df.where(F.col(time).isNull())
    n = untimed.count()
    if n <= part_rows:
        return number_rows(df, keys, time, ties, out, slot_us)
    timed = number_rows(df.where(F.col(time).isNotNull()), keys, time, ties, out, slot_us)
    dealt = untimed.repartitionByRange(-(-n // part_rows) + 1, *keys, *ties).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "untimed")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    first = df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_timed"))
    starts = small_side(join_scope(offsets, first, keys, "left").withColumn("_off", F.col("_off") + F.coalesce("_timed", F.lit(0))).drop("_timed"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*ties)
    rest = join_scope(dealt, starts, [*keys, "_part"]).withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("long"))
    return timed.unionByName(rest.drop("_part", "_off"))


def last_known(df: DataFrame, keys: Sequence[str], seq: str, value: Column, out: str, block: int = 16 * BLOCK) -> DataFrame:
    """Latest non-null `value` among the earlier rows of the session."""
    df = df.withColumn("_val", value).withColumn("_blk", ((F.col(seq) - F.col(seq) % block) / block).cast("long"))
    per_block = df.groupBy(*keys, "_blk").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(seq))).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*keys, "_blk", F.last("_last", ignorenulls=True).over(w).alias("_carry"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(carried, [*keys, "_blk"])
            .withColumn(out, F.coalesce(F.last("_val", ignorenulls=True).over(inside), F.col("_carry")))
            .drop("_val", "_blk", "_carry"))

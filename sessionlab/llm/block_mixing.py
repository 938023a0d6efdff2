"""Mixing sources to target weights by fixed-length blocks.

The words of each source are packed into blocks of `block_words`: its documents are dealt by hash into buckets, laid end
to end there and cut. The mix is a row of slots in shards of `shard_slots`; each shard draws how many of its slots each
source fills (multinomial, with the whole parts of the expected counts fixed), and the source's slots are numbered through
all shards. Slot k of a source with B blocks takes, in pass k div B, the block that a keyed permutation of 0..B-1 puts at
k mod B; three passes at most. Blocks and slots meet by a join on the block's number.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words by weight; a target stops at
three times its source's words and the rest is shared again by weight.

Defined results: a null or empty text has size 0 and takes 0; a repeated row is a document of its own, rows that share an id (or have
none) are dealt by their text and number; an empty table gives
an empty result, one without words targets of 0; columns other than id, text and source are not read. The table of
sources, one row each, passes the driver and goes to every task: at most `MAX_SOURCES` sources, more raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import join_scope, materialize, small_side
from .common import WORD, before, repeated, text_key

BLOCK_WORDS = 64
SHARD_SLOTS = 1024
BUCKET_WORDS = 1 << 16
BUCKET_DOCS = 1 << 10
GROUP = 4096
WEIGHTS = (1, 2, 3)
PASSES = 3
MAX_SOURCES = 1_000_000
SEED = 42


def targets(sizes: list[int]) -> list[float]:
    """Words that each source, in order, is to give."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    left, weights, out = float(sum(sizes)), sum(weight), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: PASSES * sizes[i] / weight[i]):  # the first to be full come first
        out[i] = min(float(PASSES * sizes[i]), left * weight[i] / weights)
        left -= out[i]
        weights -= weight[i]
    return out


def permuted(x: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of 0..size-1: a Feistel network on the next even number of bits, walked until it lands inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64).copy(), np.arange(len(x))
    while len(todo):
        h, m, k, v = half[todo], mask[todo], key[todo], out[todo]
        a, b = v >> h, v & m
        for turn in range(6):
            f = (b + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def numbered(df: DataFrame, key: str, order: str, count: str, name: str) -> DataFrame:
    """`df` with the running sum of `count` before each row, by `key` in `order` (a long), through groups of neighbours."""
    grouped = df.withColumn("_group", F.floor(F.col(order) / GROUP))
    sums = grouped.groupBy(key, "_group").agg(F.sum(count).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col(key).alias("_key"), F.col("_group").alias("_g"), F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.sum(count).over(Window.partitionBy(key, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = grouped.join(starts, (F.col(key) == F.col("_key")) & (F.col("_group") == F.col("_g")))
    return joined.withColumn(name, (F.col("_before") + F.coalesce(inner, F.lit(0))).cast("long")).drop("_group", "_key", "_g", "_before")


class Mix:
    """The plan of one mix: `placed` documents, `blocks`, and `slots` (shard, source, block)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS,
                 shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = docs.sparkSession
        self.block_words, self.shard_slots, self.seed = block_words, shard_slots, seed
        size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
        # Equal rows are counted, then numbered: no id, however many rows have it, stays in one bucket.
        sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *text_key(text_col), size.alias("size"))
        self.sized = sized = materialize(sized.groupBy("doc_id", "source", "t1", "t2", "size").agg(F.count("*").alias("copies")), "sized")
        found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("docs")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        words = [r.words for r in found]
        target = targets(words)
        plan = [(r.source, i, r.words, target[i], max(1, -(-r.words // BUCKET_WORDS), -(-r.docs // BUCKET_DOCS))) for i, r in enumerate(found)]
        self.sources = F.broadcast(spark.createDataFrame(plan, "source string, rank int, source_size long, target double, buckets long"))  # MAX_SOURCES rows at most
        rank_of = self.sources.select(F.col("source").alias("_source"), "rank", "buckets")
        dealt = repeated(sized, "copies", "nth").join(rank_of, F.col("source").eqNullSafe(F.col("_source")))
        dealt = dealt.withColumn("spot", F.xxhash64("doc_id", "t1", "t2", "nth")).withColumn("bucket", F.pmod("spot", "buckets"))
        line = Window.partitionBy("rank", "bucket").orderBy("spot", "doc_id", "t1", "t2", "nth")
        self.placed = materialize(dealt.withColumn("row", F.row_number().over(line)).withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).select(
            "rank", "bucket", "row", "doc_id", "t1", "t2", "nth", "size", (F.col("end") - F.col("size")).alias("start"), "end"), "placed")
        filled = self.placed.groupBy("rank", "bucket").agg(F.ceil(F.max("end") / block_words).cast("long").alias("n_blocks")).where("n_blocks > 0")
        self.buckets = materialize(numbered(filled, "rank", "bucket", "n_blocks", "first_block"), "buckets")
        held = {r["rank"]: r["n"] for r in self.buckets.groupBy("rank").agg(F.sum("n_blocks").alias("n")).collect()}  # one row a source
        self.held = np.array([held.get(i, 0) for i in range(len(plan))], dtype=np.int64)
        self.quota = np.array([t * b / w if w else 0.0 for t, b, w in zip(target, self.held, words)])

    def blocks(self) -> DataFrame:
        """(rank, block, bucket, at): number of each block in its source and in its bucket."""
        return self.buckets.select("rank", "bucket", F.col("first_block"), F.posexplode(F.array_repeat(F.lit(0), F.col("n_blocks").cast("int"))).alias("at", "_")).select(
            "rank", (F.col("first_block") + F.col("at")).alias("block"), "bucket", "at")

    def slots(self, spark) -> DataFrame:
        """(shard, rank, block) of every slot of the mix."""
        total = int(np.ceil(self.quota.sum()))
        share = self.quota / self.quota.sum() if total else self.quota
        size, seed, held = self.shard_slots, self.seed, self.held

        def draw(batches):
            for b in batches:
                shards, ranks, counts = [], [], []
                for shard in b.column(0).to_pylist():
                    n = min(size, total - shard * size)
                    whole = np.floor(share * n).astype(np.int64)
                    rest = share * n - whole
                    c = whole + np.random.default_rng([seed, shard]).multinomial(n - whole.sum(), rest / rest.sum()) if n > whole.sum() else whole
                    at = np.flatnonzero(c)
                    shards.append(np.full(len(at), shard))
                    ranks.append(at)
                    counts.append(c[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [[]]).astype(np.int64)) for x in (shards, ranks, counts)], names=["shard", "rank", "n"])
        counts = materialize(spark.range(-(-total // size)).mapInArrow(draw, "shard long, rank long, n long"), "draws")

        def fill(batches):
            for b in batches:
                shard, rank, n, first = (b.column(i).to_numpy() for i in range(4))
                row = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
                r = rank[row]
                inside = k < PASSES * held[r]
                k, r, row = k[inside], r[inside], row[inside]
                turn = k // held[r]
                names, back = np.unique(r * PASSES + turn, return_inverse=True)
                key = np.array([xxhash.xxh64_intdigest(f"{seed}|{x}", seed) for x in names.tolist()], dtype=np.uint64)[back] if len(r) else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(r), pa.array(permuted(k % np.maximum(held[r], 1), held[r], key))], names=["shard", "rank", "block"])
        return numbered(counts, "rank", "shard", "n", "first").select("shard", "rank", "n", "first").mapInArrow(fill, "shard long, rank long, block long")

    def taken(self) -> DataFrame:
        """doc_id, size, source, source_size, target, taken of every document."""
        return self.rows().select("doc_id", "size", "source", "source_size", "target", "taken")

    def rows(self) -> DataFrame:
        """`taken` with the rest of each row's key: t1, t2 (hash of the text) and nth (its number among equal rows of a source)."""
        spark = self.placed.sparkSession
        times = self.slots(spark).groupBy("rank", "block").agg(F.count("*").alias("times"))
        # Exploded rows look as small as what they come from: without the hints blocks would be broadcast unseen.
        used = self.blocks().hint("merge").join(times, ["rank", "block"]).select(F.col("rank").alias("_rank"), F.col("bucket").alias("_bucket"), F.col("at").alias("_at"), "times")
        w = self.block_words
        first, last = F.floor(F.col("start") / w), F.floor((F.col("end") - 1) / w)
        laid = self.placed.where("size > 0").select("rank", "bucket", "row", "start", "end", F.explode(F.sequence(first, last)).alias("at"))
        met = laid.hint("merge").join(used, (F.col("rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket")) & (F.col("at") == F.col("_at")))
        words = F.least("end", (F.col("at") + 1) * w) - F.greatest("start", F.col("at") * w)
        sums = met.groupBy("rank", "bucket", "row").agg(F.sum(words * F.col("times")).alias("taken")).withColumnsRenamed({"rank": "_rank", "bucket": "_bucket", "row": "_row"})
        joined = self.placed.join(sums, (F.col("rank") == F.col("_rank")) & (F.col("bucket") == F.col("_bucket")) & (F.col("row") == F.col("_row")), "left")
        return joined.drop("_rank").join(self.sources, "rank").select("doc_id", "t1", "t2", "nth", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of `docs` of which the mix takes words, with size, source_size, target and taken.

    Rows meet their part of the mix by id, source and text hash; equal rows, which are interchangeable, by their number too.
    """
    mix = Mix(docs, id_col, text_col, source_col)
    key = ["_mix_id", "_mix_source", "_mix_1", "_mix_2"]
    names = dict(zip(("doc_id", "source", "t1", "t2"), key))
    found = materialize(mix.rows().where("taken > 0").select("doc_id", "source", "t1", "t2", "nth", "size", "source_size", "target", "taken").withColumnsRenamed(names), "mixed")
    clear = docs.drop("size", "source_size", "target", "taken")
    keyed = clear.withColumns(dict(zip(key, (F.col(id_col), F.col(source_col), *text_key(text_col)))))
    many = mix.sized.where("copies > 1").select("doc_id", "source", "t1", "t2").withColumnsRenamed(names)
    out = ["size", "source_size", "target", "taken"]
    if many.isEmpty():
        return join_scope(keyed, found.drop("nth"), key).select(*clear.columns, *out)
    many = small_side(many)
    alone = join_scope(join_scope(keyed, many, key, "left_anti"), found.drop("nth"), key)
    twins = materialize(join_scope(keyed, many, key, "left_semi").withColumn("_mix_row", F.monotonically_increasing_id()), "equal-rows")
    counted = before(twins.select(*key, "_mix_row", F.lit(1).cast("long").alias("one"), F.shiftright("_mix_row", 12).alias("part")), key, "part", ["_mix_row"], {"nth": "one"})
    placed = join_scope(counted.select(*key, "nth", "_mix_row"), found, [*key, "nth"]).select(F.col("_mix_row").alias("row"), *out)
    told = twins.join(placed, F.col("_mix_row") == F.col("row"))
    return alone.select(*clear.columns, *out).unionByName(told.select(*clear.columns, *out))

"""Documents that share most of their word shingles: T-occurrence search over inverted lists with DivideSkip.

A document's set is its distinct shingles; equal sets are one class, of which one row does the work. A class with n shingles
can only reach the similarity (0.85, say) where it shares T = ceil(0.85 n) of them, so of its lists the T longest but one or
two may be set aside: what is linked to it stands in the others. Lists are ordered by one rule for all classes, long ones (over
`LIMIT` classes) last, the rest by hash; each class enters only the first n - T + `MERGED` of its lists. A class's short lists
are merged on a heap that skips ahead over candidates that cannot gather the needed count (MergeSkip); candidates that pass
bounds from 512 parity bits and from the first shingles of both sets are decided by binary probes of the one sorted set, long
lists included, in the other.

Which lists are long need not be counted over all shingles. Lists of the first n - T + `MERGED` shingles by hash are counted;
classes that meet a long one there move on to their next shingles, or enter all of them where twice as many do not
suffice, and this is repeated until no list newly becomes long.

Classes with so many long lists that one of them is among their first are `dense`: texts of which thousands of copies exist. Two dense
classes without a short list in common differ by all their short lists s, and by the difference of their numbers of long
lists r at least: 185 (s + s' + |r - r'|) <= 15 (n + n') must hold. In each long list the class with the most room by this bound is held against all
others; only classes for which the bound leaves a partner in another component go on, with a new head in each round. When few
are left, or after `ROUNDS` rounds, these are compared pair by pair. No list of copies is compared with itself as a whole.

Defined results: shingles are compared by 64-bit hashes; null texts and texts without words have no set and stay alone; fewer
words than a shingle are one shingle; rows of one id with different texts are documents of their own, and a component's id is
the smallest id in it, null only if there is no other; an empty table gives an empty result; columns other than id and text
are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import materialize, small_side
from .common import components, small_batches

LIMIT = 64
MERGED = 2
ROUNDS = 3
SEED = 42
PARITY_WORDS = 8
BROADCAST_NUMBERS = 500_000
BATCH_BITS = 8  # whole sets are gathered 256 at a time
BUCKETS = 256  # parts in which their shingles are gathered, at least
BUCKET_TOKENS = 1 << 20  # shingles of all sets that a part may hold
FEW_PAIRS = 4_000_000  # places in lists that may be compared pair by pair; the bound leaves few of them


@dataclass(frozen=True)
class Likeness:
    """Sets of `words`-word shingles are linked where they share part / whole of their union or more."""

    words: int
    part: int
    whole: int

    @property
    def least(self) -> int:
        """Smaller sets are linked to equal ones only: one shingle more or less is too much."""
        return max(MERGED, -(-self.part // (self.whole - self.part)))

    def threshold(self, n: int) -> int:
        """Shingles a set of `n` shares with any set it is linked to."""
        return -(-self.part * n // self.whole)

    def first(self, n: Column) -> Column:
        """Lists that a class of `n` shingles enters."""
        return n - F.ceil(n * self.part / F.lit(float(self.whole))) + MERGED

    def needed(self, n: Column, m: Column) -> Column:
        """Shingles that sets of `n` and `m` must share to be linked."""
        return F.ceil((n + m) * self.part / F.lit(float(self.part + self.whole))).cast("long")

    def fits(self, n: Column, m: Column) -> Column:
        """Whether sets of `n` and `m` can be linked at all."""
        return (n * self.part <= m * self.whole) & (m * self.part <= n * self.whole)


LIKENESS = Likeness(4, 85, 100)


def shingles(text: str | None, size: int = LIKENESS.words) -> np.ndarray:
    """The different shingles of a text as sorted signed 64-bit hashes."""
    words = (text or "").encode().lower().split()  # bytes: lower() is A-Z, split() is ASCII white space
    if len(words) < size:
        runs = {b" ".join(words)} if words else set()
    else:
        runs = set(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(r, SEED) for r in runs), dtype=np.uint64, count=len(runs)).view(np.int64))


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes(), SEED)


def parity(found: np.ndarray) -> np.ndarray:
    """512 bits, each whether an odd number of shingles falls on it: two sets differ in as many shingles as bits at least."""
    odd = (np.bincount(found & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


SKETCH = "set_key binary, n long, head array<long>, parity array<long>"


def sketch(found: np.ndarray, like: Likeness) -> tuple:
    """set_key, n, head (the first shingles by hash, twice the lists to enter) and parity of a set; the last two empty where it can only equal others."""
    n = len(found)
    if n < like.least:
        return set_key(found), n, found[:0], found[:0]
    return set_key(found), n, found[:2 * (n - like.threshold(n) + MERGED)], parity(found)


def sketch_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]


def sketches(docs: DataFrame, like: Likeness) -> DataFrame:
    """The sketch of every row (doc_id, text)."""
    def run(batches):
        for b in batches:
            made = sketch_columns([sketch(shingles(t, like.words), like) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *made], names=["doc_id", "set_key", "n", "head", "parity"])
    return small_batches(docs).mapInArrow(run, f"doc_id long, {SKETCH}")


def near_side(df: DataFrame) -> DataFrame:
    """A written table of single numbers as a join side: broadcast where there are at most `BROADCAST_NUMBERS`, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_NUMBERS + 1).count() <= BROADCAST_NUMBERS else df


def full_sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, found: all shingles in order) of the classes `wanted` (id, set_key, rep); `docs` (doc_id, text) are read again for them."""
    ids = small_side(wanted.select(F.col("rep").alias("_rep")).distinct())

    def run(batches):
        for b in batches:
            found = [shingles(t, size) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(u) for u in found], type=pa.binary()), pa.array(found, type=pa.list_(pa.int64()))], names=["set_key", "found"])
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    read = materialize(small_batches(texts).mapInArrow(run, "set_key binary, found array<long>").join(small_side(wanted.select("set_key", "id")), "set_key").select("id", "found"), "whole-sets")
    # Rows that repeat an id and its text would count twice; mostly there are none, and the sets need not be exchanged.
    return read if read.count() <= wanted.count() else read.groupBy("id").agg(F.first("found").alias("found"))


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(value, number of lists) of the values that stand in `need` of the sorted lists or more."""
    out = []
    heap = [(values[0], i, 0) for i, values in enumerate(lists) if values]
    heapq.heapify(heap)
    while len(heap) >= need:
        low, popped = heap[0][0], []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            out.append((low, len(popped)))
            for _, i, at in popped:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        # Nothing below the need-th front can be met often enough: all lists popped here skip to it.
        while len(popped) < need - 1:
            popped.append(heapq.heappop(heap))
        front = heap[0][0] if heap else None
        for _, i, at in popped:
            at = len(lists[i]) if front is None else bisect_left(lists[i], front, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return out


def merged_lists(posts: DataFrame, like: Likeness) -> DataFrame:
    """Candidate pairs (a, b) from posts (token, id, n, dense), whose lists are short.

    A list goes to each of its members with the members after it that fit by size. Two dense classes may share one short
    list only, others share `MERGED` of them.
    """
    lists = posts.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("id", "n", "dense"))).alias("all")).where(F.size("all") > 1)
    each = lists.select("all", F.posexplode("all").alias("at", "me"))
    after = F.filter(F.slice("all", F.col("at") + 2, F.size("all")), lambda m: like.fits(m.n, F.col("me.n")))
    after = F.transform(after, lambda m: F.shiftleft(m.id, 1) + m.dense.cast("long"))
    rows = each.select(F.col("me.id").alias("a"), F.col("me.dense").alias("dense"), after.alias("after")).where(F.size("after") > 0)
    rows = rows.groupBy("a").agg(F.first("dense").alias("dense"), F.collect_list("after").alias("lists"))

    def run(batches):
        for batch in batches:
            left, right = [], []
            for a, dense, lists in zip(*(c.to_pylist() for c in batch.columns)):
                for b, count in merge_skip(lists, 1 if dense else MERGED):
                    if count >= MERGED or dense and b & 1:
                        left.append(a)
                        right.append(b >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])
    return rows.mapInArrow(run, "a long, b long")


def paired(pairs: DataFrame, arrays: DataFrame, keep) -> DataFrame:
    """Of `pairs` (a, b, na, nb, least) those for which `keep(na, nb, least, x, y)` holds of the arrays (id, found) of both."""
    met = pairs.join(arrays.withColumnsRenamed({"id": "a", "found": "fa"}), "a").join(arrays.withColumnsRenamed({"id": "b", "found": "fb"}), "b")

    def run(batches):
        for batch in batches:
            numbers = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            kept = [bool(keep(*n, x.values.to_numpy(), y.values.to_numpy())) for n, x, y in zip(numbers, batch.column(5), batch.column(6))]
            yield pa.RecordBatch.from_arrays(batch.columns[:5], names=["a", "b", "na", "nb", "least"]).filter(pa.array(kept, type=pa.bool_()))
    return small_batches(met).select("a", "b", "na", "nb", "least", "fa", "fb").mapInArrow(run, "a long, b long, na long, nb long, least long")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Numbers that two sorted sets share: binary probes of the smaller one in the larger."""
    few, many = sorted((x, y), key=len)
    if not len(few):
        return 0
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return int((many[at] == few).sum())


def heads_agree(n: int, m: int, least: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets may share `least`, by their first shingles: in the range both show, they differ by no more than the whole sets may."""
    ends = [h[-1] for h, size in ((x, n), (y, m)) if len(h) < size]
    if ends:  # short of the end itself: of numbers cut to their upper halves, others may be equal to it
        x, y = x[:np.searchsorted(x, min(ends))], y[:np.searchsorted(y, min(ends))]
    return len(x) + len(y) - 2 * common(x, y) <= n + m - 2 * least


def probed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Of `pairs` (a, b: classes of `sets`) those that are linked: by bounds from parity and from the first shingles, then by binary probes of the whole sets."""
    known = sets.select("id", "n", "parity")
    both = pairs.join(known.withColumnsRenamed({"id": "a", "n": "na", "parity": "pa"}), "a").join(known.withColumnsRenamed({"id": "b", "n": "nb", "parity": "pb"}), "b")
    least = like.needed(F.col("na"), F.col("nb"))
    bits = reduce(Column.__add__, [F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY_WORDS)])
    left = both.where((least <= F.least("na", "nb")) & (bits <= F.col("na") + F.col("nb") - 2 * least)).select("a", "b", "na", "nb", least.alias("least"))
    left = materialize(left, "candidates")

    def members(of: DataFrame) -> DataFrame:
        return materialize(of.select(F.col("a").alias("id")).unionByName(of.select(F.col("b").alias("id"))).distinct(), "members")
    # Upper halves keep the order, and what they hide can only make two sets look closer.
    upper = F.transform("head", lambda x: F.shiftright(x, 32).cast("int"))
    heads = sets.join(near_side(members(left)), "id", "left_semi").select("id", upper.alias("found"))
    left = materialize(paired(left, heads, heads_agree), "likely")
    wanted = materialize(sets.join(near_side(members(left)), "id", "left_semi").select("id", "set_key", "rep"), "wanted")
    found = paired(left, full_sets(wanted, docs, like.words), lambda n, m, least, x, y: common(x, y) >= least)
    return materialize(found.select("a", "b"), "links")


def beside_copies(whole: DataFrame) -> DataFrame:
    """Whole sets (id, found) in ranges of their first shingle: near copies mostly stand in one batch, and no group of copies in one task."""
    return whole.repartitionByRange(F.col("found")[0], "id").sortWithinPartitions(F.col("found")[0], "id")


def dealt(sets: DataFrame) -> DataFrame:
    """(batch, bucket, tokens, counts): the shingles of sets (batch, buckets, found) with the sets they stand in, gathered within each batch.

    A row holds what a batch has in one of the `buckets`, not a single shingle: shingles that stand in one set only would each be a row.
    """
    def run(batches):
        for rows in batches:
            found = rows.column(2).combine_chunks() if isinstance(rows.column(2), pa.ChunkedArray) else rows.column(2)
            flat, of = found.flatten().to_numpy(zero_copy_only=False), np.repeat(rows.column(0).to_numpy(zero_copy_only=False), found.value_lengths().to_numpy(zero_copy_only=False))
            buckets = rows.column(1)[0].as_py() if len(rows) else 1
            for batch in np.unique(of):
                tokens, counts = np.unique(flat[of == batch], return_counts=True)
                bucket = np.mod(tokens, buckets)
                order = np.argsort(bucket, kind="stable")
                names, first = np.unique(bucket[order], return_index=True)
                ends = pa.array(np.r_[first, len(tokens)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), batch)), pa.array(names), *(pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int64))) for x in (tokens, counts))],
                                                 names=["batch", "bucket", "tokens", "counts"])
    return small_batches(sets).select(F.col("batch").cast("long"), F.col("buckets").cast("long"), "found").mapInArrow(run, "batch long, bucket long, tokens array<long>, counts array<long>")


def by_token(whole: DataFrame) -> DataFrame:
    """`dealt` of whole sets (id, found and, where they have them, batch and buckets): copies share their shingles, which then are few."""
    plain = {c: F.lit(v) for c, v in (("batch", 0), ("buckets", BUCKETS)) if c not in whole.columns}
    return dealt(whole.withColumns(plain))


def frequent(lists: DataFrame, least: int) -> DataFrame:
    """(token, e) of the shingles of `lists` (`dealt`) that stand in more than `least` sets; a group is one bucket."""
    def summed(rows: pa.Table) -> pa.Table:
        flat, counts = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("tokens", "counts"))
        tokens, back = np.unique(flat, return_inverse=True)
        e = np.bincount(back, weights=counts, minlength=len(tokens)).astype(np.int64)
        return pa.table({"token": tokens[e > least], "e": e[e > least]})
    return lists.select("bucket", "tokens", "counts").groupBy("bucket").applyInArrow(summed, "token long, e long")


def apart(whole: DataFrame, lists: DataFrame, long: DataFrame, buckets: int) -> DataFrame:
    """(id, n, near, far) of whole sets (id, n, batch, found): near, the shingles whose lists are not `long` (token), and far, the others.

    The long ones among the shingles of each batch are found by bucket; then each batch's sets meet them. No shingle is a row of its own.
    """
    def held(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        known = theirs.column("token").to_numpy()
        lists = [x.values.to_numpy() for x in mine.column("tokens")]
        lists = [x[np.isin(x, known)] for x in lists]
        met = [i for i, x in enumerate(lists) if len(x)]
        return pa.table({"batch": mine.column("batch").take(pa.array(met, type=pa.int64())), "tokens": pa.array([lists[i] for i in met], type=pa.list_(pa.int64()))})
    by_bucket = long.select("token", F.pmod("token", F.lit(buckets).cast("long")).alias("bucket")).groupBy("bucket")
    here = lists.select("batch", "bucket", "tokens").groupBy("bucket").cogroup(by_bucket).applyInArrow(held, "batch long, tokens array<long>")

    def cut(sets: pa.Table, theirs: pa.Table) -> pa.Table:
        known = np.unique(theirs.column("tokens").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        found = [x.values.to_numpy() for x in sets.column("found")]
        far = [np.isin(x, known) for x in found]
        kind = pa.list_(pa.int64())
        return pa.table({"id": sets.column("id"), "n": sets.column("n"), "near": pa.array([x[~f] for x, f in zip(found, far)], type=kind), "far": pa.array([x[f] for x, f in zip(found, far)], type=kind)})
    sets = whole.select("id", "n", "batch", "found").groupBy("batch")
    return sets.cogroup(here.groupBy("batch")).applyInArrow(cut, "id long, n long, near array<long>, far array<long>")


def marked(heads: DataFrame, known: np.ndarray) -> DataFrame:
    """Of `heads` (id, n, head) those that meet one of the sorted numbers `known`: near, the other numbers of the head, and far, these."""
    def run(batches):
        for batch in batches:
            head = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            flat, of = head.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(batch)), head.value_lengths().to_numpy(zero_copy_only=False))
            hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
            met = np.bincount(of[hit], minlength=len(batch)) > 0
            parts = []
            for part in (~hit & met[of], hit):
                ends = np.cumsum(np.bincount(of[part], minlength=len(batch))[met])
                parts.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat[part])))
            kept = batch.filter(pa.array(met))
            yield pa.RecordBatch.from_arrays([*kept.columns[:2], kept.column(2), *parts], names=["id", "n", "head", "near", "far"])
    return small_batches(heads).select("id", "n", "head").mapInArrow(run, "id long, n long, head array<long>, near array<long>, far array<long>")


def posted(sets: DataFrame, docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame | None]:
    """Posts (token, id, n, dense) of the short lists, and (token, id, n, s) of the long lists that dense classes enter (None if none is long)."""
    room = like.first(F.col("n")).cast("int")

    def lengths(posts: DataFrame) -> DataFrame:
        return materialize(posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "list-lengths")

    def cleared(heads: DataFrame) -> DataFrame:
        """Of the classes (id, n, head) that meet a long list in their heads: near, the other lists there, and far, the long ones."""
        known = long.select("token").limit(BROADCAST_NUMBERS + 1).toArrow().column(0).to_numpy()
        if len(known) <= BROADCAST_NUMBERS:  # they go to the heads, which then are not exchanged
            return marked(heads, np.sort(known))
        hits = heads.select("id", F.explode("head").alias("token")).join(long, "token", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("far"))
        return heads.join(materialize(hits, "long-hits"), "id").withColumn("near", F.array_except("head", "far"))

    def first_lists(of: DataFrame) -> DataFrame:
        return of.select("id", "n", F.explode(F.slice("head", F.lit(1), room)).alias("token"))

    def resting() -> DataFrame:
        """Classes that have not moved on, with their first lists."""
        return first_lists(sets.select("id", "n", "head").join(near_side(gone), "id", "left_anti"))

    def shared(posts: DataFrame) -> DataFrame:
        """Posts of lists that more than one class enters: each list's length is counted where its posts meet, so that they are exchanged once."""
        return posts.withColumn("_c", F.count("*").over(Window.partitionBy("token"))).where("_c > 1").drop("_c")

    brief = first_lists(sets)
    counts = lengths(brief)
    long = new = materialize(counts.where(F.col("c") > LIMIT).select("token"), "long-lists")
    if long.isEmpty():
        return shared(brief).withColumn("dense", F.lit(False)), None
    whole = entered = moved = gone = None
    buckets = max(BUCKETS, -(-(sets.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS))
    for turn in count():
        # Only classes that meet a list which has newly become long go on.
        heads = sets.select("id", "n", "head")
        if moved is not None:
            now = resting().select("id", "token").unionByName(moved.where("not lacks").select("id", F.explode("taken").alias("token")))
            met = materialize(now.join(near_side(new), "token", "left_semi").select("id").distinct(), "long-met")
            if met.isEmpty():
                break
            heads = heads.join(near_side(met), "id", "left_semi")
        # Where most of the first lists are long, the others will be too: such classes enter whole at once.
        went = cleared(heads).withColumns({"lacks": (F.size("near") < room) | (2 * F.size("far") > room), "taken": F.slice("near", F.lit(1), room)})
        went = materialize(went.select("id", "n", "lacks", F.when(~F.col("lacks"), F.col("taken")).alias("taken"), F.array_except("taken", F.slice("head", F.lit(1), room)).alias("fresh")), "moved-on")
        lacking = materialize(sets.join(small_side(went.where("lacks").select("id")), "id", "left_semi").select("id", "set_key", "rep", "n"), "lacking")
        more = beside_copies(full_sets(lacking, docs, like.words).withColumn("n", F.size("found").cast("long")))
        numbered = F.shiftright(F.monotonically_increasing_id(), BATCH_BITS) + F.lit(min(turn, 127) << 56)
        more = materialize(more.withColumns({"batch": numbered, "buckets": F.lit(buckets)}), "entered-whole")
        fresh = dealt(went.where("not lacks").select(F.lit(-1).alias("batch"), F.lit(buckets).alias("buckets"), F.col("fresh").alias("found")))
        lists = materialize(by_token(more).unionByName(fresh), "entered-lists")
        moved = went if moved is None else moved.join(went.select("id"), "id", "left_anti").unionByName(went)
        gone = moved.select("id")
        whole = more if whole is None else whole.unionByName(more)
        entered = lists if entered is None else entered.unionByName(lists)
        # A list of one is not among the counts; a length may come out too high, which only makes the list a long one. Lists that
        # grow may do so to twice the limit, and a few of them beyond it, which ends the search for further ones sooner.
        grown = materialize(frequent(entered, LIMIT), "list-growth")
        size = F.col("e") + F.coalesce("c", F.lit(1))
        met = counts.join(near_side(grown.select("token")), "token", "left_semi")
        over = grown.join(met, "token", "left").where(size > 2 * LIMIT).select("token", size.alias("size"))
        new = materialize(over.join(long, "token", "left_anti"), "long-lists")
        if (new.agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0) <= FEW_PAIRS:
            break
        new = new.select("token")
        long = materialize(long.unionByName(new), "long-lists")
    split = apart(whole, entered.where("batch >= 0"), long, buckets).withColumn("s", F.size("near").cast("long"))
    split = materialize(split.withColumn("dense", F.col("s") < room), "split-lists")
    near = split.select("id", "n", "dense", F.explode(F.slice("near", F.lit(1), room)).alias("token"))
    light = moved.where("not lacks").select("id", "n", F.lit(False).alias("dense"), F.explode("taken").alias("token"))
    others = resting().withColumn("dense", F.lit(False))
    posts = reduce(DataFrame.unionByName, (others, light, near))
    far = split.where("dense").select("id", "n", "s", F.explode(F.slice("far", F.lit(1), room - F.col("s").cast("int"))).alias("token"))
    return shared(posts), materialize(far, "dense-posts")


class Dense:
    """Links of dense classes that share no short list, by heads of long lists."""

    def __init__(self, posts: DataFrame, like: Likeness):
        total, share = like.part + like.whole, like.whole - like.part
        # A pair is possible where f + g' <= 0 and f' + g <= 0.
        self.rows = posts.select("token", "id", ((total - share) * F.col("n")).alias("f"), (total * (2 * F.col("s") - F.col("n")) - share * F.col("n")).alias("g"))

    @staticmethod
    def fits(a: str, b: str) -> Column:
        return (F.col(f"{a}.f") + F.col(f"{b}.g") <= 0) & (F.col(f"{b}.f") + F.col(f"{a}.g") <= 0)

    @staticmethod
    def ordered(a: str, b: str) -> tuple[Column, Column]:
        return F.least(f"{a}.id", f"{b}.id").alias("a"), F.greatest(f"{a}.id", f"{b}.id").alias("b")

    def stars(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs of each list's head, the class with the most room, with the others that fit; and the rows without the heads."""
        heads = materialize(rows.groupBy("token").agg(F.min(F.struct("g", "f", "id")).alias("h")).select("token", "h.*"), "heads")
        pairs = rows.alias("x").join(heads.alias("h"), (F.col("x.token") == F.col("h.token")) & (F.col("x.id") != F.col("h.id")) & self.fits("x", "h"))
        return pairs.select(*self.ordered("x", "h")).distinct(), rows.join(heads, ["token", "id"], "left_anti")

    def open(self, rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows for which the bound leaves a partner in another component."""
        placed = with_root(rows, roots)
        per = placed.groupBy("token", "root").agg(F.min("g").alias("g"), F.min("f").alias("f"))
        first = per.groupBy("token").agg(F.min(F.struct("g", "root")).alias("g1"), F.min(F.struct("f", "root")).alias("f1"))
        per = per.join(first, "token")
        second = per.groupBy("token").agg(F.min(F.when(F.col("root") != F.col("g1.root"), F.col("g"))).alias("g2"), F.min(F.when(F.col("root") != F.col("f1.root"), F.col("f"))).alias("f2"))
        known = placed.join(first, "token").join(second, "token")
        other_g = F.when(F.col("root") == F.col("g1.root"), F.col("g2")).otherwise(F.col("g1.g"))
        other_f = F.when(F.col("root") == F.col("f1.root"), F.col("f2")).otherwise(F.col("f1.f"))
        return known.where((F.col("f") + other_g <= 0) & (F.col("g") + other_f <= 0)).select("token", "id", "f", "g", "root")

    def pairs(self, rows: DataFrame) -> DataFrame:
        a, b = rows.alias("x"), rows.alias("y")
        return a.join(b, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & self.fits("x", "y")).select(*self.ordered("x", "y")).distinct()


def with_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    """`df` (id) with its component among `roots` (node, root), itself if it has none."""
    found = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(found, F.col("id") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "id")).drop("_node", "_root")


def jaccard_links(sets: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) that connect exactly the classes which all links of the likeness connect.

    `sets` has id, rep (a row's id in `docs`) and the sketch of each class that is not too small; `docs` is (doc_id, text).
    """
    posts, far = posted(sets, docs, like)
    pairs = merged_lists(posts, like)
    if far is None or far.isEmpty():
        return probed(materialize(pairs, "pairs"), sets, docs, like)
    dense = Dense(far, like)
    stars, rows = dense.stars(dense.rows)
    links = probed(materialize(pairs.unionByName(stars).distinct(), "pairs"), sets, docs, like)
    for turn in range(ROUNDS):
        rows = materialize(dense.open(rows.select("token", "id", "f", "g"), components(links)), "open")
        if rows.isEmpty():
            return links
        squares = rows.groupBy("token").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        if turn == ROUNDS - 1 or squares <= FEW_PAIRS:
            return links.unionByName(probed(materialize(dense.pairs(rows), "pairs"), sets, docs, like))
        new, rows = dense.stars(rows)
        links = materialize(links.unionByName(probed(materialize(new, "pairs"), sets, docs, like)), "links")
    return links


def classes_of(rows: DataFrame) -> DataFrame:
    """Of sketched rows with a number `row`: the classes (set_key, id: the smallest row, rep: the smallest doc_id, copies)."""
    return materialize(rows.groupBy("set_key").agg(F.min("row").alias("id"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")


def sets_of(rows: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """The sketch of each class that is not too small, as its first row has it: the other rows of the classes are left out."""
    again = rows.join(classes.where("copies > 1").select(F.col("set_key").alias("_key"), "id"), (F.col("set_key") == F.col("_key")) & (F.col("row") != F.col("id"))).select(F.col("row").alias("_row"))
    kept = rows.where(F.col("n") >= like.least).join(small_side(again), F.col("row") == F.col("_row"), "left_anti")
    return kept.select(F.col("row").alias("id"), "set_key", F.col("doc_id").alias("rep"), "n", "head", "parity")


def jaccard_components(docs: DataFrame, like: Likeness = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(sketches(docs, like).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = classes_of(rows.where("n > 0"))
    roots = components(jaccard_links(sets_of(rows, classes, like), docs, like))
    placed = with_root(classes, roots)
    lowest = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("rows"))
    labels = small_side(placed.join(lowest.where("rows > 1"), "root").select(F.col("set_key").alias("_key"), "component_id"))
    return rows.join(labels, F.col("set_key") == F.col("_key"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

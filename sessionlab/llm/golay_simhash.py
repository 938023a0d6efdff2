"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into three segments, each a word of the perfect (23, 12) Golay code with errors. Two words
that differ in two bits or fewer have a codeword in common within distance 4 of both (the code's spheres of radius 3 hold
the word midway), and a word has one or six such codewords. Of three segments with two errors in all, one has none. So
fingerprints within two bits meet in a key made of one whole segment and a codeword index of the next: 3 to 18 keys each.
Keys are joined and pairs verified. Where a key holds more than `BUCKET` fingerprints, its members are linked another
exact way: two fingerprints are within two bits if and only if they have a neighbour within one bit in common, so each
member goes to its 65 neighbours and is linked to the smallest member found there; no bucket's pairs are written out.

Copies of a similarity of 0.8 on five-word shingles differ in about ten of 64 bits, out of reach of such keys. For them
(`similar_documents`) the links above are joined by the exact links of that similarity (`jaccard_join`).

Defined results: null and empty texts have fingerprint zero; equal fingerprints are one class, however many rows hold it;
a null id is never a component's id unless the component has no other; an empty table gives an empty result; columns other
than id and text are not read. Where one row of each component is kept, rows are known by id and a 128-bit hash of the text:
it is the one with the smallest id, of rows that share this id the one with the smallest hash, of equal rows any one. Rows
with a null id are always kept.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import materialize, small_side
from . import jaccard_join
from .common import components, map_columns, small_batches, text_key

# The generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the code, and the seed of the hash.
GENERATOR = 0b110001110101
SEED = 42

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
MAX_BITS = 2
BUCKET = 64

# Similar documents: words of a shingle and similarity.
ALIKE = jaccard_join.Likeness(5, 4, 5)


def hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of every run of `size` words (fewer words: of them all), repeats included."""
    if len(words) < size:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    return [digest(r, SEED) for r in runs]


def majority(h: np.ndarray) -> int:
    """The bits set in over half of `h`. Eight bit positions at a time are counted in the bytes of a 64-bit sum."""
    if not len(h):
        return 0
    bits = np.zeros(64, dtype=np.int64)
    ones = np.uint64(0x0101010101010101)
    for shift in range(8):
        lanes = (h >> np.uint64(shift)) & ones
        sums = np.add.reduceat(lanes, np.arange(0, len(h), 255))  # 255 ones fit a byte
        bits[shift::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * bits > len(h)).tolist())


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode().lower().split()  # bytes: lower() is A-Z, split() is ASCII white space
    return majority(np.array(hashes(words, size), dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2 (the text's hash) and fp (the fingerprint as a signed long) of every row."""
    def run(ids, t1, t2, texts):
        return ids, t1, t2, np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)
    return map_columns(docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text_col), F.col(text_col).alias("text")), run, "doc_id long, t1 long, t2 long, fp long")


def remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Tables of the code: syndromes by half word, and the error patterns of weight 4 or less of every syndrome."""

    def __init__(self):
        self.low = np.array([remainder(v) for v in range(4096)], dtype=np.int64)
        self.high = np.array([remainder(v << 12) for v in range(2048)], dtype=np.int64)
        patterns: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for places in combinations(range(23), weight):
                e = sum(1 << p for p in places)
                patterns[remainder(e)].append(e)
        self.errors = np.full((2048, 6), -1, dtype=np.int64)
        for s, found in enumerate(patterns):
            self.errors[s, :len(found)] = found

    def nearby(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices (12 bits) of the codewords within distance 4 of each word, -1 where there are fewer."""
        e = self.errors[self.low[words & 0xFFF] ^ self.high[words >> 12]]
        return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


_golay: list[Golay] = []


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64) and the row each key belongs to."""
    if not _golay:
        _golay.append(Golay())
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    keys, rows = [], []
    for i in range(3):
        near = _golay[0].nearby(parts[(i + 1) % 3])
        row, col = np.nonzero(near >= 0)
        keys.append((i << 34) | (parts[i][row] << 12) | near[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def golay_keys(classes: DataFrame) -> DataFrame:
    """(key, fp) for every key of every fingerprint of `classes`."""
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            key, row = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])
    return classes.select("fp").mapInArrow(run, "key long, fp long")


def fingerprint_links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints of `classes` (fp, distinct) that differ in two bits or fewer.

    In small buckets these are all such pairs; members of large buckets are linked through common neighbours.
    """
    keys = materialize(golay_keys(classes), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keys.join(sizes, "key"), "golay-buckets")
    few = met.where(F.col("n") <= bucket).select("key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    beside = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(flips).alias("mid"))
    heads = beside.groupBy("mid").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = beside.hint("merge").join(heads, "mid").where("fp != head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    return pairs.unionByName(stars).distinct()


def fingerprint_roots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `rows` (doc_id, fp): the classes (fp, rep: its smallest id, n) and the links' components (node, root: fingerprints)."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    roots = materialize(components(fingerprint_links(classes)), "roots")
    return classes, roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _fingerprint_components(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1, t2, fp, root and component_id of every row; the last two null where no other row is linked."""
    rows = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    classes, nodes = fingerprint_roots(rows)
    placed = nodes.join(classes, nodes.node == classes.fp).select("node", "root", "rep")
    lowest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = placed.join(lowest, "root").select(F.col("node").alias("fp"), "root", "component_id")
    alone = classes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("rep").alias("component_id"))
    labels = small_side(linked.unionByName(alone)).withColumnRenamed("fp", "label_fp")
    return rows.join(labels, F.col("fp") == F.col("label_fp"), "left").drop("label_fp")


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id reachable over links of two differing bits or fewer."""
    return _fingerprint_components(docs, size, id_col, text_col).select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_set(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the different ones as a sorted signed array."""
    h = np.array(hashes((text or "").encode().lower().split(), size), dtype=np.uint64)
    return h, np.unique(h.view(np.int64))


def _similar_components(docs: DataFrame, like: jaccard_join.Likeness, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t1, t2, root and component_id of every row; the last two null where no other row is linked."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fps, made = [], []
            for text in b.column(3).to_pylist():
                h, found = shingle_set(text, like.words)
                fps.append(majority(h))
                made.append(jaccard_join.sketch(found, like))
            fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], fps, *jaccard_join.sketch_columns(made)], names=["doc_id", "t1", "t2", "fp", "set_key", "n", "head", "parity"])
    rows = small_batches(docs).select("doc_id", *text_key("text"), "text").mapInArrow(run, f"doc_id long, t1 long, t2 long, fp long, {jaccard_join.SKETCH}")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = jaccard_join.classes_of(rows)

    fps = materialize(rows.select("fp", "set_key").distinct().join(classes, "set_key").select("fp", "id"), "fingerprints")
    heads = materialize(fps.groupBy("fp").agg(F.min("id").alias("head")), "fingerprint-heads")
    same = fps.join(heads, "fp").where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    far = fingerprint_links(heads).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("of_a")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("of_b")), "b")
    near = same.unionByName(far.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))

    sets = jaccard_join.sets_of(rows, classes, like)
    roots = components(near.unionByName(jaccard_join.jaccard_links(sets, docs, like)))
    placed = jaccard_join.with_root(classes, roots)
    lowest = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("rows"))
    labels = small_side(placed.join(lowest.where("rows > 1"), "root").select(F.col("set_key").alias("label_key"), "root", "component_id"))
    return rows.join(labels, F.col("set_key") == F.col("label_key"), "left").select("doc_id", "t1", "t2", "root", "component_id")


def similar_documents(docs: DataFrame, like: jaccard_join.Likeness = ALIKE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: the smallest id reachable over fingerprint links and links of a Jaccard similarity of 0.8 or more."""
    return _similar_components(docs, like, id_col, text_col).select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def _first_of_each(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with one row of each component of `placed`, and all rows without a component or an id."""
    key = ["doc_id", "t1", "t2"]
    placed = materialize(placed.where("root is not null and doc_id is not null").groupBy("root", *key).agg(F.count("*").alias("copies")), "components")
    leaders = placed.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct(*key)).alias("first"))
    judged = materialize(placed.join(leaders, F.col("root") == F.col("_root")).select(*(F.col(c).alias(f"_{c}") for c in key), (F.struct(*key) == F.col("first")).alias("leads"), "copies"), "judged")
    keyed = docs.withColumns(dict(zip(("_key_id", "_key_1", "_key_2"), (F.col(id_col).cast("long"), *text_key(text_col)))))
    test = (F.col("_key_id") == F.col("_doc_id")) & (F.col("_key_1") == F.col("_t1")) & (F.col("_key_2") == F.col("_t2"))
    left = keyed.join(small_side(judged.where("not leads")), test, "left_anti")
    twins = judged.where("leads and copies > 1")
    if not twins.isEmpty():
        twins = small_side(twins)
        left = left.join(twins, test, "left_anti").unionByName(left.join(twins, test, "left_semi").dropDuplicates(["_key_id", "_key_1", "_key_2"]))
    return left.drop("_key_id", "_key_1", "_key_2")


def one_of_each(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, columns unchanged: of each component the row with the smallest id, and all rows without an id."""
    return _first_of_each(docs, _fingerprint_components(docs, size, id_col, text_col), id_col, text_col)


def one_of_similar(docs: DataFrame, like: jaccard_join.Likeness = ALIKE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs`, columns unchanged: of each component of similar documents the row with the smallest id, and all rows without an id."""
    return _first_of_each(docs, _similar_components(docs, like, id_col, text_col), id_col, text_col)

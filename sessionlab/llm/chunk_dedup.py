"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts a text at starts of words, about every sixth word, so an insertion moves
only the cuts beside it. Chunks are compared by digest. Of a chunk that occurs in several documents the document with
the smallest id keeps it (of rows that share it, the text with the smallest hash), of one that repeats within a document the first place; the others are removed where
neighbouring removable chunks add up to `min_words` words.

Defined results: a null text stays null and an empty one empty; rows that repeat an id with the same text are one document
and get the same result; rows of one id with other texts, null ids included, are told apart by 64 bits of a text hash and are documents of
their own; a null id keeps nothing that a real id has; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, map_columns

MIN_WORDS = 12
CUT_SHARE = 43      # of 256: share of word starts that are cuts
LONG_CHUNK = 512    # bytes from which cuts need no word start
MAX_CHUNK = 4096    # bytes of the longest chunk

_SEED = 42
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), _SEED) & 0xFFFF for b in range(256)], dtype=np.uint16)


def rolling(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after every byte: sum of gear[byte j places back] << j, built by doubling."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        n = h.copy()
        n[s:] += h[:-s] << np.uint16(s)
        h = n
    return h


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of `data`, the last being its length."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8)
    high = rolling(b) >> np.uint16(8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    found = np.flatnonzero(white[:-1] & ~white[1:] & (high[:-1] < CUT_SHARE)) + 1
    ends = np.append(found, n)
    gaps = np.diff(ends, prepend=0)
    if (gaps > LONG_CHUNK).any():
        letter = (b & 0xC0) != 0x80
        more = [ends]
        for k in np.flatnonzero(gaps > LONG_CHUNK).tolist():
            at, end = int(ends[k] - gaps[k]), int(ends[k])
            inner = np.flatnonzero(letter[at + 1:end] & (high[at:end - 1] < 2)) + at + 1
            more.append(inner)
            bounds = [at, *inner.tolist(), end]
            for lo, hi in zip(bounds, bounds[1:]):
                while hi - lo > MAX_CHUNK:
                    lo += MAX_CHUNK
                    while lo > 0 and not letter[lo]:
                        lo -= 1
                    more.append(np.array([lo]))
        ends = np.unique(np.concatenate(more))
    return ends


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, span, tag, again) of every chunk of `docs` (doc_id, text, tag): span is start << 20 | length."""
    shape = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64()), ("span", pa.int64()), ("tag", pa.int64()), ("again", pa.bool_())])

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            digests, spans, again, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                ends = cuts(data)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                view = memoryview(data)
                d = [digest(view[a:e]) for a, e in zip(starts.tolist(), ends.tolist())]
                seen: set[int] = set()
                again.extend(x in seen or seen.add(x) is not None for x in d)
                digests.extend(d)
                spans.append((starts << 20) | (ends - starts))
                counts.append(len(d))
            row = np.repeat(np.arange(len(counts)), counts)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), batch.column(0).take(take),
                 pa.array(np.concatenate(spans).astype(np.int64)), batch.column(2).take(take), pa.array(again, type=pa.bool_())], schema=shape)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.mapInArrow(run, "digest long, doc_id long, span long, tag long, again boolean")


def remove_spans(text: str, spans: list[int], min_words: int) -> tuple[str, int, int, str]:
    """Text without the runs of `spans` that have `min_words` words; runs, words removed, and their byte ranges."""
    data = text.encode()
    runs: list[list[int]] = []
    for s in sorted(set(spans)):
        at, end = s >> 20, (s >> 20) + (s & 0xFFFFF)
        if runs and runs[-1][1] == at:
            runs[-1][1] = end
        else:
            runs.append([at, end])
    kept, last, words, ranges = [], 0, 0, []
    for at, end in runs:
        n = len(data[at:end].split())
        if n >= min_words:
            kept.append(data[last:at])
            last, words = end, words + n
            ranges.append(f"{at}-{end}")
    kept.append(data[last:])
    return b"".join(kept).decode(), len(ranges), words, " ".join(ranges)


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without repeated passages, n_removed (runs), removed_words, removed_bytes (ranges "start-end" in UTF-8).

    Shuffled are the chunks (four numbers each), twice: to find the first document of each digest, which is a partial
    minimum before the shuffle, and to join it back, a plain join that adaptive execution splits at a hot passage.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    chunks = chunk_rows(base.select("doc_id", "text", "tag"))
    firsts = chunks.where("not again").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        "digest", F.col("first.doc_id").alias("first_id"), F.col("first.tag").alias("first_tag"), F.lit(True).alias("met"))
    joined = chunks.join(firsts, "digest", "left")
    extra = joined.where(F.col("again") | (F.col("met") & ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tag") == F.col("first_tag")))))
    spans = extra.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans")).withColumnsRenamed({"doc_id": "span_id", "tag": "span_tag"})
    found = base.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("tag") == F.col("span_tag")), "left").select("doc_id", "text", "spans")

    def run(ids, texts, spans):
        out = [remove_spans(t, s, min_words) if t and s else (t, 0, 0, "") for t, s in zip(texts, spans)]
        return ids, *([o[k] for o in out] for k in range(4))
    return map_columns(found, run, "doc_id long, text string, n_removed long, removed_words long, removed_bytes string")

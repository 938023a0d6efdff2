"""Quality rules by document and by host.

Base rules look at one document. Their failures are summed by host (`source`); a host's failure rate is shrunk towards
the rate of all hosts by a beta prior whose strength is estimated from the hosts themselves, and a host whose shrunk
rate is above `max_rate` loses all its documents.

Defined results: a null text has no words and fails; null hosts are one host of their own; a repeated row counts as
often as it occurs; an empty table gives an empty result; columns other than id, text and host are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import materialize, small_side
from .common import WORD, map_columns

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MAX_RATE = 0.5

_WORD = re.compile(WORD)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words that lie in windows of `size` words found twice or more in the list, the first occurrence included.

    A polynomial of the words' hashes finds candidate windows; windows that meet are then compared word by word.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    roll = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        roll *= _MULTIPLIER
        roll += h[k:n + k]
    order = np.argsort(roll, kind="stable")
    same = roll[order[1:]] == roll[order[:-1]]
    if not same.any():
        return 0
    suspects = np.zeros(n, dtype=bool)
    suspects[order[1:][same]] = True
    suspects[order[:-1][same]] = True
    at: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(suspects).tolist():
        at.setdefault(tuple(words[i:i + size]), []).append(i)
    marked = np.zeros(len(words) + 1, dtype=np.int64)
    for places in at.values():
        if len(places) > 1:
            np.add.at(marked, places, 1)
            np.add.at(marked, [p + size for p in places], -1)
    return int((np.cumsum(marked) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its counts and whether it fails the base rules."""
    def run(ids, hosts, texts):
        counts = [text_counts(t) for t in texts]
        return ids, hosts, *([c[k] for c in counts] for k in range(5))
    found = map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")), run,
                        "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def host_verdicts(checked: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host of `checked` (host, base_failed): documents, failures, shrunk rate, verdict.

    The prior's mean m is the rate of all documents. Of the weighted variance of the hosts' rates, m(1-m)(hosts)/(documents)
    is what chance alone gives; the rest, v, is between hosts and gives the prior the strength m(1-m)/v - 1, one document
    at least. Where nothing is left between hosts, every host gets the common rate.
    """
    hosts = materialize(checked.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), "hosts")
    total = hosts.agg(F.count("*"), F.sum("host_docs"), F.sum("host_failed")).first()
    k, n, m = total[0], total[1] or 1, (total[2] or 0) / (total[1] or 1)
    spread = hosts.agg(F.sum(F.col("host_docs") * F.pow(F.col("host_failed") / F.col("host_docs") - F.lit(m), 2))).first()[0] or 0.0
    between = spread / n - m * (1 - m) * k / n
    strength = max(m * (1 - m) / between - 1, 1.0) if between > 0 else None
    rate = (F.col("host_failed") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength)) if strength else F.lit(m)
    return hosts.withColumn("host_rate", rate.cast("double")).withColumn("host_rejected", F.col("host_rate") > F.lit(max_rate))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Every document's counts, base rules, host figures and final verdict `kept`. The counts are written once, without texts."""
    checked = materialize(base_rules(docs, id_col, text_col, host_col), "base-rules")
    verdicts = small_side(host_verdicts(checked, max_rate)).withColumnRenamed("host", "verdict_host")
    joined = checked.join(verdicts, checked.host.eqNullSafe(F.col("verdict_host")), "left").drop("verdict_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Rows of `docs`, columns unchanged, that pass: rejected hosts go by a join, failing rows by the same base rules."""
    checked = materialize(base_rules(docs, id_col, text_col, host_col), "base-rules")
    bad = small_side(host_verdicts(checked, max_rate).where("host_rejected").select(F.col("host").alias("bad_host")))
    left = docs.join(bad, F.col(host_col).eqNullSafe(F.col("bad_host")), "left_anti")

    def passes(batches):
        import pyarrow as pa
        for b in batches:
            keep = []
            for text in b.column(text_col).to_pylist():
                n, _, _, _, again = text_counts(text)
                keep.append(n >= MIN_WORDS and 100 * again <= MAX_REPEATED_PERCENT * n)
            yield b.filter(pa.array(keep, type=pa.bool_()))
    return left.mapInArrow(passes, left.schema)

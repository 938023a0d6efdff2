"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text's windows are compressed with
either; a window that the toxic dictionary makes shorter speaks for toxicity. Counts of such windows at several gains,
the largest gains and the mean are turned into a score by a logistic fit on documents that neither dictionary has seen.

Toxic documents are mostly ordinary words, and a dictionary trained on all of their text is much like one trained on
ordinary text. So the toxic one is trained on what sets them apart: of each word the longest start that stands in
`MIN_DOCS` toxic documents at least and in them `MIN_RATIO` times as often as in ordinary ones. A window is one word.

Fitted on the driver on a bounded sample: `sample` toxic and twice as many ordinary documents of at most `LONGEST`
characters, by hash order of their ids. Scoring reads every whole text.

Defined results: null and empty texts have one window without gain; without labels of both kinds the score is the share of
toxic labels (0 where there are none); repeated labels of one id count as toxic if one of them does, null labels are
left out; a null id is not held out; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

SAMPLE = 2500
LONGEST = 20_000
TOXIC_BYTES, ORDINARY_BYTES = 8192, 32768
ORDINARY_WORDS = 300_000
# Length of the pieces that training counts and of the segments it picks, and words of a training sample.
PIECE, SEGMENT, SAMPLE_WORDS = 6, 32, 8
MIN_DOCS, MIN_RATIO = 4, 20.0
GAINS = (2, 4, 6, 8)
CACHED, CACHED_LENGTH = 300_000, 64
# A compressor looks for no match in a window's last bytes; padding puts the whole window before them.
PADDING = b"\n" * 12


def windows(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z)."""
    return (text or "").encode().lower().split()


def starts(word: bytes) -> list[bytes]:
    w = b" " + word + b" "
    return [w[:n] for n in range(5, min(len(w), 24) + 1)]


def trained(words: list[bytes], size: int) -> bytes:
    """A dictionary trained on the words; the words themselves where they are too few to train one."""
    samples = [b"".join(words[i:i + SAMPLE_WORDS]) for i in range(0, len(words), SAMPLE_WORDS)]
    try:
        return zstandard.train_dictionary(size, samples, d=PIECE, k=SEGMENT).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(words))[-size:] or b" " * 8


def dictionaries(texts: list[str], toxic: list[int]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary."""
    seen, total = (Counter(), Counter()), [0, 0]
    for text, y in zip(texts, toxic):
        seen[y].update({s for w in set(windows(text)) for s in starts(w)})
        total[y] += 1
    least = min(MIN_DOCS, max(2, total[1] // 20))
    apart = {s for s, n in seen[1].items() if n >= least and (n / total[1]) / ((seen[0][s] + 0.5) / max(total[0], 1)) >= MIN_RATIO}
    unlike, usual = [], []
    for text, y in zip(texts, toxic):
        if y:
            longest = (max((s for s in starts(w) if s in apart), key=len, default=None) for w in windows(text))
            unlike += [s for s in longest if s]
        else:
            usual += [b" " + w + b" " for w in windows(text)]
    step = -(-len(usual) // ORDINARY_WORDS) or 1
    return trained(unlike, TOXIC_BYTES), trained(usual[::step], ORDINARY_BYTES)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content)
    params = zstandard.ZstdCompressionParameters.from_level(
        3, dict_size=len(content), source_size=64, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Gains(dict):
    """Window -> bytes that the toxic dictionary saves against the ordinary one; starts anew when `CACHED` are held."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = compressor(toxic).compress, compressor(ordinary).compress

    def __missing__(self, window: bytes) -> int:
        data = b" " + window + b" " + PADDING
        gain = len(self.ordinary(data)) - len(self.toxic(data))
        if len(window) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[window] = gain
        return gain

    def features(self, text: str | None) -> list[float]:
        g = np.array(list(map(self.__getitem__, windows(text))) or [0])
        top = np.sort(g)[-3:]
        return [float(top[-1]), float(top.mean()), float(g.mean()), float(np.log(len(g))), *(float(np.log1p((g >= x).sum())) for x in GAINS), *(float((g >= x).mean()) for x in GAINS[1:])]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (intercept last) of a ridge logistic fit by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def training_sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> tuple[list[str], list[int]]:
    """Texts and labels; every fifth id by crc32 is held out. The ids are drawn from the labels alone and then looked up."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, sample), (0, 2 * sample))]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("drawn_id"), "toxic"))  # 3 x sample rows at most
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    rows = found.join(ids, F.col("doc_id") == F.col("drawn_id")).select("doc_id", "text", "toxic").collect()
    rows = sorted({(r.doc_id, r.text, int(r.toxic == 1)) for r in rows})[: 6 * sample]
    return [r[1] for r in rows], [r[2] for r in rows]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(texts: list[str], toxic: list[int]):
    """A model: the two dictionaries and the logistic fit, or a constant. Even rows of either label make the dictionaries, odd rows the fit."""
    turn, half = [0, 0], []
    for y in toxic:
        half.append(turn[y] % 2)
        turn[y] += 1
    if min(turn) < 4:
        return sum(toxic) / len(toxic) if toxic else 0.0
    first = [i for i, h in enumerate(half) if not h]
    content = dictionaries([texts[i] for i in first], [toxic[i] for i in first])
    gains = Gains(*content)
    second = [i for i, h in enumerate(half) if h]
    x, y = np.array([gains.features(texts[i]) for i in second]), np.array([toxic[i] for i in second], dtype=float)
    return content, logistic(x, y)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`; `labels` has doc_id and toxic."""
    model = fit(*training_sample(docs, labels, sample, id_col, text_col))

    def run(ids, held, texts):
        if isinstance(model, float):
            score = np.full(len(texts), model)
        else:
            (content, (mean, scale, w)) = model
            if _gains.get("of") != content:
                _gains.update(of=content, gains=Gains(*content))
            x = np.array([_gains["gains"].features(t) for t in texts]).reshape(len(texts), -1)
            score = 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, -30, 30))) if len(texts) else np.zeros(0)
        return ids, held, score, (score >= 0.5).astype(int).tolist()
    return map_columns(docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")), run,
                       "doc_id long, held_out boolean, score double, predicted int")


_gains: dict = {}

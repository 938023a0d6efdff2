"""Fill-in-the-middle rearrangement with a container set of token boundaries.

The boundaries of a text's tokens (runs of ASCII letters, any other character by itself) are a set of code point offsets,
kept as in a Roaring bitmap: one container per 65,536 offsets, an array of the low halves where few are set, runs of
consecutive offsets where those are shorter, a bitmap otherwise, and the cardinalities summed from container to container. A cut after k
tokens is the k-th boundary: the container is found by binary search in the sums, the offset by a select inside it. Which
cuts and which form a document gets is decided by a hash of its id, so reruns agree.

Defined results: a null or empty text has no tokens and stays plain; a null id is hashed as an empty one; repeated rows are
each rearranged alike; an empty table gives an empty result; columns other than id and text are not read. Texts of any
length are cut as a whole: containers are built one by one from slices of the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

# The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SPAN = 1 << 16
ARRAY_MAX = 4096  # offsets of an array container; more take less room as a bitmap of 8 kB
FORMS = "doc_id long, n long, form string, cut1 long, cut2 long, output string"


class ArrayContainer:
    def __init__(self, offsets: np.ndarray):
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class RunContainer:
    """Runs of consecutive offsets by first offset, with the number of offsets before each."""

    def __init__(self, offsets: np.ndarray, firsts: np.ndarray):
        self.starts = offsets[firsts].astype(np.uint16)
        self.before = firsts.astype(np.uint32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BitmapContainer:
    """1024 words of 64 bits, with the number of bits before each word."""

    def __init__(self, offsets: np.ndarray):
        bits = np.zeros(SPAN, dtype=np.uint8)
        bits[offsets] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = bits.reshape(-1, 64).sum(axis=1, dtype=np.uint32)
        self.before = np.cumsum(counts, dtype=np.uint32) - counts

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1


def container(offsets: np.ndarray):
    """The smallest of the three forms for sorted offsets below 65,536."""
    firsts = np.flatnonzero(np.diff(offsets, prepend=-2) != 1)
    if 4 * len(firsts) < min(2 * len(offsets), SPAN // 8):
        return RunContainer(offsets, firsts)
    return ArrayContainer(offsets) if len(offsets) <= ARRAY_MAX else BitmapContainer(offsets)


class Boundaries:
    """The boundaries of a text: the start of every token, and the end of the text. `select(k)` is where the first k tokens end."""

    def __init__(self, text: str):
        self.spans, self.parts, self.sums = [], [], [0]
        in_letters = False
        for at in range(0, len(text), SPAN):
            code = np.frombuffer(text[at:at + SPAN].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            letter = ((code | 32) - 97) < 26  # unsigned: what is below "a" wraps round
            inside = letter.copy()
            inside[1:] &= letter[:-1]
            inside[0] &= in_letters
            in_letters = bool(letter[-1])
            self._add(at, np.flatnonzero(~inside))
        self.length = len(text)

    def _add(self, at: int, offsets: np.ndarray) -> None:
        if len(offsets):
            self.spans.append(at)
            self.parts.append(container(offsets))
            self.sums.append(self.sums[-1] + len(offsets))

    def __len__(self) -> int:
        """Tokens of the text."""
        return self.sums[-1]

    def select(self, k: int) -> int:
        if k == self.sums[-1]:
            return self.length
        i = bisect_right(self.sums, k) - 1
        return self.spans[i] + self.parts[i].select(k - self.sums[i])


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def rearranged(doc_id: int | None, text: str | None, seed: int, plain_from: int, spm_below: int) -> tuple:
    """(tokens, form, end of the prefix, end of the middle, output); the cuts are None in the plain form."""
    text = text or ""
    marks = Boundaries(text)
    n, h = len(marks), draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = marks.select(i), marks.select(j)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_below:
        return n, "spm", a, b, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, cut1, cut2 (code point offsets, null where plain) and output of every row.

    Of 100 documents `plain_from` are rearranged, `spm_below` in 100 of these with the suffix first.
    """
    def run(ids, texts):
        rows = [rearranged(i, t, seed, plain_from, spm_below) for i, t in zip(ids, texts)]
        return [ids, *zip(*rows)] if rows else [[] for _ in FORMS.split(",")]
    return map_columns(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, FORMS)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from, by its form alone."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at, end = F.position(F.lit(second), output, F.lit(len(first) + 1)), F.position(F.lit(MIDDLE), output, F.lit(len(first) + 1))
        head = F.substring(output, F.lit(len(first) + 1), at - len(first) - 1)
        tail = F.substring(output, at + len(second), end - at - len(second))
        return head, tail, F.substring(output, end + len(MIDDLE), F.length(output))
    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)

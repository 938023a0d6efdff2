"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the strings of added tokens, each part into pretokens by the byte-level pattern, each pretoken into
bytes. The adjacent pair of lowest rank (leftmost on ties) is popped from a heap and merged in a linked list until no
pair has a rank; a pretoken's tokens are its bytes minus its merges. No identifiers are produced.

Defined results: null and empty texts have 0 bytes and 0 tokens; a repeated row is counted each time; an empty table gives
an empty result; columns other than id and text are not read. A pretoken of n bytes takes O(n log n), however long.
"""

from __future__ import annotations

import heapq
import json
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

# Fixed value: the byte-level pretokenizer's pattern. White space is Unicode's property of that name.
PRETOKEN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"""
            r"""|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")

CACHED = 300_000
CACHED_LENGTH = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """Pretoken -> number of tokens; a dict that computes what it lacks and starts anew when `cached` are held."""

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], spec["normalizer"], pre["type"], pre["add_prefix_space"], pre["use_regex"]) != ("BPE", None, "ByteLevel", False, True):
            raise ValueError(f"{path} is not a byte-level BPE without normalizer and prefix space")
        vocab = model["vocab"]
        self.first = [vocab[c] for c in byte_letters()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.cached = cached

    def __missing__(self, pretoken: str) -> int:
        n = self.merged(pretoken.encode())
        if len(pretoken) <= CACHED_LENGTH:
            if len(self) >= self.cached:
                self.clear()
            self[pretoken] = n
        return n

    def merged(self, data: bytes) -> int:
        symbol = [self.first[b] for b in data]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            if m := merges.get((symbol[i], symbol[i + 1])):
                heap.append((m[0], i, symbol[i], symbol[i + 1], m[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            left -= 1
            symbol[i], symbol[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((whole, symbol[k])):
                    heapq.heappush(heap, (m[0], i, whole, symbol[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], whole))):
                heapq.heappush(heap, (m[0], h, symbol[h], whole, m[1]))
        return left

    def count(self, text: str) -> int:
        if self.added is None:
            return sum(map(self.__getitem__, self.pretokens(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pretokens(p))) for p in parts)


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. `tokenizer` names a file that every worker has."""
    def run(ids, texts):
        if tokenizer not in _counters:  # kept by a worker from task to task
            _counters[tokenizer] = Counter(tokenizer)
        counter = _counters[tokenizer]
        texts = [t or "" for t in texts]
        tokens = [counter.count(t) for t in texts]
        return ids, [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]
    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                       "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

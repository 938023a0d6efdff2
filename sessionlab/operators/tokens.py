"""Token sequences, splits, vocabularies and ids for sequence models.

Sequences are kept as rows (session, pos, token) and without padding; arrays are built only where a consumer
needs them, and then hold at most `max_len` tokens because that many are kept from the end of a session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import SESSION_KEYS, keys_of
from ..staging import hot_join, materialize
from .scan import last_known
from .stats import top_k

# Ids 0..8 are taken by these tokens in every vocabulary.
RESERVED = ["PAD", "UNK", "BOS", "EOS", "EOV", "OUT:<NA>", "DT:<NA>", "RG:<NA>", "GAP:<BOS>"]
PAD_ID, UNK_ID = 0, 1
MAX_LEN = 2048
# A token with more than one in so many rows does not go through the shuffle by token.
HOT_SHARE = 1000


def align_arrays(df: DataFrame, main: str, sides: Sequence[str], fill: str = C.NA, times: str | None = None) -> DataFrame:
    """Bring side arrays to the length of `main`: longer ones are cut, shorter ones filled, blanks become the fill."""
    n = F.size(main)

    def fit(c: str, value: Column) -> Column:
        a = F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))
        return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(value, F.greatest(n - F.size(a), F.lit(0))))

    def word(x: Column) -> Column:
        return F.when(F.trim(x) != "", x).otherwise(F.lit(fill))

    df = df.withColumns({c: F.transform(fit(c, F.lit(fill)), word) for c in sides})
    if times:
        df = df.withColumn(times, fit(times, F.lit(None).cast("timestamp")))
    return df


def _known(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c)).otherwise(F.lit(C.NA))


def _event_tokens(version: str) -> list[Column]:
    tok = F.col("token")
    gap = F.when(F.col("_prev").isNull(), F.lit("<BOS>")).otherwise(C.gap_label(C.elapsed_s(F.col("_prev"), F.col("event_time"))))
    out, dt = F.concat(F.lit("OUT:"), _known("outcome_class")), F.concat(F.lit("DT:"), _known("dt_bucket"))
    gap, named, end = F.concat(F.lit("GAP:"), gap), F.concat(F.lit("TOK:"), tok), F.lit("EOV")
    if version == "v0":
        return [tok]
    if version == "v1":
        return [named, out, dt, gap, end]
    if version == "v2":
        return [F.concat(F.lit("RG:"), _known("route_group")), out, dt, gap, named,
                F.concat(F.lit("OP:"), C.token_field(tok, "op")), F.concat(F.lit("OUT2:"), C.token_field(tok, "out")),
                F.concat(F.lit("DT2:"), C.token_field(tok, "dt")), end]
    raise ValueError(f"unknown version {version}")


def token_rows(events: DataFrame, version: str, keys: Sequence[str] = SESSION_KEYS, max_len: int = MAX_LEN) -> DataFrame:
    """(keys, pos, seq_len, token): BOS, the tokens of each event, EOS; the last `max_len` of each session.

    `pos` counts from 0 after cutting. Events that cannot reach the kept tail are dropped before they are
    spread into tokens.
    """
    keys = keys_of(keys, events)
    ev = events
    if version != "v0":
        ev = last_known(ev, keys, "seq_no", F.col("event_time"), "_prev")
    cells = _event_tokens(version)
    width = len(cells)
    # Each task keeps the last few events of a session it has seen before they are shuffled. Naming `_prev` in
    # the order (it never decides: seq_no is unique) keeps the optimizer from moving this step below its window.
    order = [F.desc("seq_no")] + ([F.asc("_prev")] if "_prev" in ev.columns else [])
    ev = top_k(ev, keys, order, max_len // width + 2, "_back")
    ev = ev.withColumn("_n", F.max("seq_no").over(Window.partitionBy(*keys)) + 1)
    total = F.col("_n") * width + 2
    first, last = F.col("seq_no") == 0, F.col("seq_no") == F.col("_n") - 1
    start = 1 + F.col("seq_no") * width
    items = [F.when(first, F.struct(F.lit(0).cast("long").alias("pos"), F.lit("BOS").alias("token")))]
    items += [F.struct((start + i).alias("pos"), c.alias("token")) for i, c in enumerate(cells)]
    items += [F.when(last, F.struct((total - 1).alias("pos"), F.lit("EOS").alias("token")))]
    rows = ev.select(*keys, total.alias("_total"), F.inline(F.array_compact(F.array(*items))))
    cut = F.greatest(F.col("_total") - max_len, F.lit(0))
    return rows.where(F.col("pos") >= cut).select(
        *keys, (F.col("pos") - cut).alias("pos"), F.least(F.col("_total"), F.lit(max_len)).alias("seq_len"), "token")


def sequences(rows: DataFrame, keys: Sequence[str] = SESSION_KEYS, col: str = "token", out: str = "tokens") -> DataFrame:
    """One array per session from token rows."""
    keys = keys_of(keys, rows)
    cells = F.array_sort(F.collect_list(F.struct("pos", col)))
    return rows.groupBy(*keys).agg(F.max("seq_len").alias("seq_len"), F.transform(cells, lambda s: s[col]).alias(out))


def padded(df: DataFrame, col: str, max_len: int, pad, mask: str = "attention_mask") -> DataFrame:
    """Export form: arrays filled up to `max_len`, with 1 for real places in the mask."""
    n = F.least(F.size(col), F.lit(max_len))
    fill = F.lit(max_len) - n
    return df.withColumn(mask, F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill))).withColumn(
        col, F.concat(F.slice(col, F.lit(1), n), F.array_repeat(F.lit(pad), fill)))


def sequence_text(df: DataFrame, col: str = "tokens", out: str = "text") -> DataFrame:
    return df.withColumn(out, F.array_join(col, " "))


def with_split(df: DataFrame, blake: bool = False) -> DataFrame:
    """90 / 5 / 5 split of sessions by a stable hash of client, user and session."""
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("client_name", "user_id", "session_key")])
    return df.withColumn("split", C.split_name(C.blake_bucket(key) if blake else C.stable_bucket(key)))


def token_counts(rows: DataFrame, by: Sequence[str] = ("client_name",)) -> DataFrame:
    return rows.groupBy(*by, "token").agg(F.count("*").alias("freq"))


def vocabulary(rows: DataFrame, by: Sequence[str] = ("client_name",), min_freq: int = 3, max_vocab: int = 50_000) -> DataFrame:
    """(by, token, id, freq): the reserved tokens, then the others by frequency and name."""
    counts = token_counts(rows, by)
    usual = counts.where(~F.col("token").isin(RESERVED) & (F.col("freq") >= min_freq))
    kept = top_k(usual, by, [F.desc("freq"), F.asc("token")], max(max_vocab - len(RESERVED), 0), "place").select(
        *by, "token", (F.col("place") + len(RESERVED) - 1).cast("long").alias("id"), "freq")
    fixed = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).cast("long").alias("id")) for i, t in enumerate(RESERVED)])
    reserved = counts.select(*by).distinct().select(*by, F.inline(fixed)).join(counts, [*by, "token"], "left")
    return reserved.select(*by, "token", "id", F.coalesce("freq", F.lit(0)).alias("freq")).unionByName(kept)


def coverage(rows: DataFrame, vocab: DataFrame, by: Sequence[str] = ("client_name",), pad_to: int | None = None) -> DataFrame:
    """Share of token occurrences the vocabulary knows; `pad_to` counts the padding of a padded table as known."""
    counts = token_counts(rows, by).join(vocab.select(*by, "token", F.lit(1).alias("_known")), [*by, "token"], "left")
    per = counts.groupBy(*by).agg(F.sum("freq").alias("total"), F.sum(F.when(F.col("_known") == 1, F.col("freq")).otherwise(0)).alias("known"))
    if pad_to:
        pads = rows.where(F.col("pos") == 0).groupBy(*by).agg(F.sum(F.lit(pad_to) - F.col("seq_len")).alias("_pad"))
        per = per.join(pads, list(by)).withColumns({c: F.col(c) + F.col("_pad") for c in ("total", "known")}).drop("_pad")
    size = vocab.groupBy(*by).agg(F.count("*").alias("vocab_size"))
    return per.join(size, list(by)).withColumn("coverage", F.col("known") / F.col("total"))


def hot_tokens(counts: DataFrame, by: Sequence[str], share: int = HOT_SHARE) -> DataFrame:
    """Tokens that hold more than 1/share of all occurrences of `counts` (by, token, freq): fewer than `share` rows, whatever the data."""
    total = counts.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    return counts.where(F.col("freq") * share > total).select(*by, "token")


def token_ids(rows: DataFrame, vocab: DataFrame, by: Sequence[str] = ("client_name",)) -> DataFrame:
    """Add `token_id`; unknown tokens get the id of UNK.

    `rows` are read twice: counted first, so that tokens with a share of all rows meet the vocabulary on a map side and
    only the others are exchanged by token.
    """
    counts = materialize(token_counts(rows, by), "token-counts")
    ids = vocab.select(*by, "token", F.col("id").alias("_id"))
    fixed = F.create_map(*[x for i, t in enumerate(RESERVED) for x in (F.lit(t), F.lit(i).cast("long"))])
    met = hot_join(rows, ids, [*by, "token"], hot_tokens(counts, by))
    return met.withColumn("token_id", F.coalesce(fixed[F.col("token")], "_id", F.lit(UNK_ID).cast("long"))).drop("_id")

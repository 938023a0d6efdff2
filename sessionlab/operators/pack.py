"""Between event rows and one-row-per-session arrays.

A session longer than `chunk_events` takes several rows, numbered by `chunk`; every event is kept and no
array grows without limit. Sessions up to that length are one row, as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import ARRAY_COLUMNS, COLUMN_VARIANTS, SESSION_KEYS, TIME_COLUMNS, keys_of
from .scan import number_untimed

CHUNK = 50_000
REQUIRED = ("user_id", "client_name", "session_key")


def is_array(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.ArrayType)


def time_column(df: DataFrame) -> str | None:
    return next((c for c in TIME_COLUMNS if c in df.columns), None)


def canonical_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in COLUMN_VARIANTS.items()
                                  if old in df.columns and new not in df.columns})


def shape_of(df: DataFrame, keys: Sequence[str] = REQUIRED) -> str:
    """`packed_session` by schema, else `event_level` when a key repeats, else `session_fallback`."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"missing key columns: {missing}")
    named = canonical_names(df)
    if any(c in named.columns and is_array(named, c) for c in ARRAY_COLUMNS):
        return "packed_session"
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return "session_fallback" if repeated.isEmpty() else "event_level"


def conform_events(df: DataFrame, day: str | None = None) -> DataFrame:
    """Canonical event columns from whatever spelling arrives, with defaults for what is absent."""
    df = canonical_names(df)
    t = time_column(df)
    df = df.withColumn("event_time", F.col(t).cast("timestamp") if t else F.lit(None).cast("timestamp"))
    for c, default in (("route_group", "unknown_route"), ("outcome_class", "unknown")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default))
    if day is not None:
        df = df.withColumn("day", F.lit(day))
    return df.withColumn("token", C.short_token(F.col("route_group"), F.col("outcome_class")))


def pack_numbered(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, chunk_events: int = CHUNK) -> DataFrame:
    """Pack events that carry `seq_no`: aligned arrays in event order, from one sorted list of structs."""
    keys = keys_of(keys, events)
    cols = ["event_time", "route_group", "outcome_class", "token"] + (["dt_bucket"] if "dt_bucket" in events.columns else [])
    chunk = ((F.col("seq_no") - F.col("seq_no") % chunk_events) / chunk_events).cast("long")
    rows = (events.groupBy(*keys, chunk.alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("seq_no").alias("observation_id"), *cols))).alias("e")))
    arrays = ["event_time", "observation_id"] + cols[1:]
    return rows.select(*keys, "chunk", *[F.col(f"e.{c}").alias(c) for c in arrays])


def cut_arrays(df: DataFrame, arrays: Sequence[str], required: Sequence[str] | None = None,
               ignore_empty: bool = False) -> DataFrame:
    """Cut `arrays` to the shortest of `required` (default: all); with `ignore_empty`, empty ones do not count."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in (required or arrays)]
    if ignore_empty:
        shortest = F.array_min(F.filter(F.array(*sizes), lambda n: n > 0))
    else:
        shortest = F.array_min(F.array(*sizes))
    df = df.withColumn("min_len", F.coalesce(shortest, F.lit(0)))
    return df.withColumns({c: F.slice(c, F.lit(1), F.col("min_len")) for c in arrays})


def explode_meta(df: DataFrame, arrays: Sequence[str], required: Sequence[str],
                 ordering: str = "event_time ASC, observation_id ASC") -> DataFrame:
    """What cutting will do to each row: original lengths, the common length, how much each array loses."""
    size = {c: F.coalesce(F.size(c), F.lit(0)) for c in arrays}
    shortest = F.array_min(F.array(*[size[c] for c in required]))

    def by_name(value) -> Column:
        return F.create_map(*[x for c in arrays for x in (F.lit(c), value(c))])

    return df.withColumn("explode_meta", F.struct(
        by_name(lambda c: size[c]).alias("original_lengths"), shortest.alias("min_len"),
        by_name(lambda c: F.greatest(size[c] - shortest, F.lit(0))).alias("truncated_counts"),
        F.lit(ordering).alias("ordering_key")))


def _texts(col: Column) -> Column:
    return F.transform(col, lambda x: x.cast("string"))


def conform_packed(df: DataFrame, day: str | None = None) -> DataFrame:
    """Canonical packed columns from packed input of any spelling; text cells are read as lists."""
    df = canonical_names(df)
    present = [c for c in ARRAY_COLUMNS if c in df.columns]
    df = df.withColumns({c: C.parse_list(F.col(c)) for c in present if not is_array(df, c)})
    df = cut_arrays(df, present, ignore_empty=True).drop("min_len")
    none = F.array().cast("array<string>")
    df = df.withColumns({c: F.coalesce(_texts(F.col(c)), none) if c in present else none
                         for c in ("route_group", "outcome_class")})
    n = F.least(F.size("route_group"), F.size("outcome_class"))
    built = F.zip_with(F.slice("route_group", F.lit(1), n), F.slice("outcome_class", F.lit(1), n),
                       lambda r, o: F.concat(r, F.lit(":"), o))
    if "token" in present:
        df = df.withColumn("token", F.when(F.size("token") > 0, _texts(F.col("token"))).otherwise(built))
    else:
        df = df.withColumn("token", built)
    if "event_time" not in present:
        df = df.withColumn("event_time", F.array().cast("array<timestamp>"))
    elif not isinstance(df.schema["event_time"].dataType.elementType, (T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn("event_time", C.parse_times(_texts(F.col("event_time"))))
    # Surrogate ids 0..n-1. With 0 <= n the sequence would run downwards for n = 0, hence the guard.
    ids = F.when(F.size("token") > 0, F.sequence(F.lit(0).cast("long"), F.size("token").cast("long") - 1)) \
        .otherwise(F.array().cast("array<long>"))
    # A session in several rows is numbered through already.
    if not ("chunk" in df.columns and isinstance(dict((f.name, f.dataType) for f in df.schema.fields).get("observation_id"), T.ArrayType)):
        df = df.withColumn("observation_id", ids)
    if day is not None:
        df = df.withColumn("day", F.lit(day))
    if "chunk" not in df.columns:
        df = df.withColumn("chunk", F.lit(0).cast("long"))
    keep = [*SESSION_KEYS, "chunk", "event_time", "observation_id", "route_group", "outcome_class", "token"]
    return df.select(*keep, *(["dt_bucket"] if "dt_bucket" in present else []))


def pack(df: DataFrame, day: str, chunk_events: int = CHUNK) -> DataFrame:
    """Canonical packed sessions of one day from event rows, packed rows, or one plain row per session."""
    mode = shape_of(df)
    if mode == "event_level":
        ev = conform_events(df, day)
        ties = [c for c in ("observation_id", "event_id") if c in ev.columns] or \
            [c for c in ev.columns if c not in (*SESSION_KEYS, "event_time")]
        out = pack_numbered(number_untimed(ev, list(SESSION_KEYS), "event_time", ties), SESSION_KEYS, chunk_events)
    elif mode == "packed_session":
        out = conform_packed(df, day)
    else:
        named = canonical_names(df)
        wrap = {c: F.when(F.col(c).isNull(), F.array().cast(T.ArrayType(named.schema[c].dataType))).otherwise(F.array(c))
                for c in ("route_group", "outcome_class", "token", "event_time") if c in named.columns}
        out = conform_packed(named.withColumns(wrap), day)
    return out.withColumn("source_mode", F.lit(mode))


def unpack(packed: DataFrame, keys: Sequence[str] = SESSION_KEYS, arrays: Sequence[str] | None = None) -> DataFrame:
    """Event rows of packed sessions. `seq_no` is the place in the session; rows without events vanish."""
    keys = keys_of(keys, packed)
    arrays = list(arrays or [c for c in ("event_time", "observation_id", "route_group", "outcome_class", "token", "dt_bucket")
                             if c in packed.columns])
    cut = cut_arrays(packed, arrays)
    rows = cut.select(*keys, F.inline(F.arrays_zip(*arrays)))
    return rows.withColumn("seq_no", F.col("observation_id")) if "observation_id" in arrays else rows


def empty_sessions(packed: DataFrame, required: Sequence[str]) -> DataFrame:
    """Sessions that cannot be ranked because a required array is empty."""
    n = F.array_min(F.array(*[F.coalesce(F.size(c), F.lit(0)) for c in required]))
    return packed.where(n == 0)

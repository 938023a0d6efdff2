"""Trace and observation rows -> ordered, tokenised events of sessions -> one row per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import GAP_COUNTS, OUTCOME_COUNTS, ROUTE_COUNTS, SESSION_KEYS, keys_of
from ..staging import materialize

MINUTE_US = 60_000_000


def time_slice(df: DataFrame, start: str, end: str, column: str = "created_at") -> DataFrame:
    """Live rows of the half-open range [start, end); both predicates reach the file scan."""
    t = F.col(column)
    return df.where((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")) & (F.col("is_deleted") == 0))


def join_events(traces: DataFrame, observations: DataFrame, start: str, end: str,
                trace_start: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """One classified row per observation whose trace names a user, with the columns `extra` of the observation.

    `trace_start` widens the trace range backwards, so that late observations of earlier traces keep
    their user; by default both tables are cut to the same range.
    """
    tr = time_slice(traces, trace_start or start, end).select(
        "project_id", F.col("id").alias("trace_id"),
        C.user_id(F.col("user_id"), F.col("metadata")).alias("user_id"),
        F.nullif(F.col("session_id"), F.lit("")).alias("session_id"),
        F.col("metadata")[C.META_CLIENT].alias("t_client"),
        F.col("metadata")[C.META_ROUTE].alias("t_route"))
    ob = time_slice(observations, start, end).select(
        "project_id", F.col("id").alias("observation_id"), "trace_id", F.col("created_at").alias("event_time"),
        F.col("name").alias("obs_name"), "level",
        F.col("metadata")[C.META_CLIENT].alias("o_client"),
        F.col("metadata")[C.META_ROUTE].alias("o_route"), *extra)
    path = C.route(F.col("o_route"), F.col("t_route"))
    return (ob.join(tr, ["project_id", "trace_id"], "left")
            .where(F.col("user_id").isNotNull())
            .select("project_id", "trace_id", "observation_id", "user_id",
                    C.client_name(F.col("o_client"), F.col("t_client")).alias("client_name"),
                    "session_id", "event_time", "obs_name", "level", path.alias("route"),
                    C.route_group(path).alias("route_group"),
                    C.outcome_class(F.col("obs_name"), F.col("level")).alias("outcome_class"), *extra))


def entity_of(events: DataFrame) -> tuple[str, ...]:
    """Whose events make up sessions: a user with a client, within a project where the rows name one."""
    return (("project_id",) if "project_id" in events.columns else ()) + ("user_id", "client_name")


def sessionize(events: DataFrame, gap_minutes: int = 30, entity: Sequence[str] | None = None,
               split_days: bool = False, tz: str = "UTC", stage: bool = True) -> DataFrame:
    """Give every event its session, its place in it, and the time since the one before.

    `entity` names whose events they are: by default project (where there is one), user and client. Rows with a session id belong to that session. The others are cut where the clock passes
    `gap_minutes` minute boundaries without an event. `split_days` starts anew at every local
    midnight, as separate runs per day would.

    All events of one minute share a session, so the cuts are found on one row per (entity, minute):
    the largest ordered group is bounded by the minutes of the range, however busy the entity is.
    """
    if gap_minutes < 1:
        raise ValueError("gap_minutes must be at least 1")
    ev = (events.withColumn("_sid", F.coalesce("session_id", F.lit("")))
          .withColumn("_has", F.col("session_id").isNotNull())
          .withColumn("_min", C.micros_bucket(F.col("event_time"), MINUTE_US)))
    entity = entity_of(events) if entity is None else entity
    part = [*entity, "_has", "_sid"]
    if split_days:
        ev = ev.withColumn("_day", C.local_day(F.col("event_time"), tz))
        part.append("_day")
    if stage:
        ev = materialize(ev, "events")

    # One structured key: its fields may be null and still compare as equal, and the order inside the minute and the join share one exchange.
    slot = F.struct(*part, "_min").alias("_slot")
    w = Window.partitionBy(*part).orderBy("_min")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.col("_min") - F.lag("_min").over(w)
    minutes = (
        ev.groupBy(*part, "_min")
        .agg(F.count("*").alias("_n"), F.min("event_time").alias("_t0"), F.max("event_time").alias("_t1"))
        .withColumn("_new", F.when(since.isNull() | (~F.col("_has") & (since >= gap_minutes)), 1).otherwise(0))
        .withColumn("_prev", F.when(F.col("_new") == 0, F.lag("_t1").over(w)))
        .withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
        .select(slot, "_prev",
                F.sum("_new").over(run).alias("_no"),
                (F.col("_before") - F.last(F.when(F.col("_new") == 1, F.col("_before")), True).over(run)).alias("_seq0"),
                F.last(F.when(F.col("_new") == 1, F.col("_t0")), True).over(run).alias("session_start")))

    inside = Window.partitionBy("_slot").orderBy("event_time", "observation_id")
    key = F.when(F.col("_has"), F.concat(F.lit("sid:"), "session_id")) \
        .otherwise(F.concat(F.lit("gap:"), F.col("_no").cast("string")))
    placed = ev.select("*", slot).withColumns({"_nth": F.row_number().over(inside), "_last": F.lag("event_time").over(inside)})
    out = (placed.join(minutes, "_slot")
           .withColumn("seq_no", (F.col("_seq0") + F.col("_nth") - 1).cast("long"))
           .withColumn("prev_time", F.coalesce("_last", "_prev"))
           .withColumn("session_key", key)
           .withColumn("day", C.local_day(F.col("session_start"), tz)))
    made = ("session_start", "seq_no", "prev_time", "session_key", "day", "dt_ms", "dt_bucket", "token")
    return finish_events(out).select(*(c for c in events.columns if c not in made), *made)


def finish_events(df: DataFrame) -> DataFrame:
    """Gap, gap bucket and token from `prev_time`."""
    ms = C.boundaries(F.col("prev_time"), F.col("event_time"), 1000)
    return (df.withColumn("dt_ms", ms)
            .withColumn("dt_bucket", C.dt_bucket(F.col("dt_ms")))
            .withColumn("token", C.event_token(F.col("client_name"), F.col("route_group"),
                                               F.col("outcome_class"), F.col("dt_bucket"))))


def day_key_sessions(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Simplest sessions: by session id, or everything of one local day."""
    day = C.local_day(F.col("event_time"), tz)
    return events.withColumn("day", day).withColumn(
        "session_key", F.when(F.col("session_id").isNotNull(), F.concat(F.lit("sid:"), "session_id"))
        .otherwise(F.concat(F.lit("gap:"), F.col("day"))))


def rollup(events: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    keys = keys_of(keys, events)
    return events.groupBy(*keys).agg(F.min("event_time").alias("session_start"),
                                     F.max("event_time").alias("session_end"),
                                     F.count("*").alias("n_events"))


def _count_of(col: str, value: str) -> Column:
    return F.count_if(F.col(col) == value).alias(f"n_{value}")


def session_features(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, min_events: int = 5) -> DataFrame:
    """Feature row per session, straight from the events: no arrays are built."""
    keys = keys_of(keys, events)
    f = events.groupBy(*keys).agg(
        F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"),
        F.count("*").alias("n_events"),
        *[_count_of("outcome_class", v) for v in OUTCOME_COUNTS],
        *[_count_of("route_group", v) for v in ROUTE_COUNTS],
        *[_count_of("dt_bucket", v) for v in GAP_COUNTS],
        F.count_distinct("token").alias("n_unique_tokens"))
    n = F.col("n_events")
    return (f.where(n >= min_events)
            .withColumn("duration_s", C.boundaries(F.col("session_start"), F.col("session_end"), 1_000_000))
            .where(F.col("duration_s") >= 0)
            .withColumns({
                "events_per_s": C.ratio(n, F.col("duration_s") + 1),
                "error_ratio": C.ratio(F.col("n_error"), n),
                "fast_ratio": C.ratio(F.col("n_t_fast"), n),
                "idle_ratio": C.ratio(F.col("n_t_idle"), n),
                "unique_token_ratio": C.ratio(F.col("n_unique_tokens"), n)}))


def features_from_packed(packed: DataFrame, keys: Sequence[str] = SESSION_KEYS, min_events: int = 5) -> DataFrame:
    """The same features when only packed sessions are at hand."""
    keys = keys_of(keys, packed)
    from .pack import unpack
    return session_features(unpack(packed), keys, min_events)


def with_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Rows whose key is in `wanted`, a key list of any size."""
    keys = keys_of(keys, df, wanted)
    return df.join(wanted.select(*keys), list(keys), "left_semi")

"""Table schemas and key lists shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical key of a session.
SESSION_KEYS = ("client_name", "day", "user_id", "session_key")


def keys_of(keys, *frames):
    """The given keys; the default ones with the project in front where all `frames` name it, so that equal users of two projects stay apart."""
    if keys is SESSION_KEYS and all("project_id" in f.columns for f in frames):
        return ("project_id", *SESSION_KEYS)
    return keys


# Rows that are compared with each other by the sequence models.
PARTITION_KEYS = ("client_name", "day")

TRACES = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("is_deleted", T.IntegerType()),
])

OBSERVATIONS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("name", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("is_deleted", T.IntegerType()),
])

PACKED = T.StructType([
    T.StructField("client_name", T.StringType()),
    T.StructField("day", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_key", T.StringType()),
    T.StructField("chunk", T.LongType()),
    T.StructField("event_time", T.ArrayType(T.TimestampType())),
    T.StructField("observation_id", T.ArrayType(T.LongType())),
    T.StructField("route_group", T.ArrayType(T.StringType())),
    T.StructField("outcome_class", T.ArrayType(T.StringType())),
    T.StructField("token", T.ArrayType(T.StringType())),
    T.StructField("dt_bucket", T.ArrayType(T.StringType())),
    T.StructField("source_mode", T.StringType()),
])

REVIEW_LOG = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("day", T.StringType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("user_id_norm", T.StringType()),
    T.StructField("session_id_norm", T.StringType()),
    T.StructField("rank", T.LongType()),
    T.StructField("if_raw", T.DoubleType()),
    T.StructField("risk_score_if", T.DoubleType()),
    T.StructField("risk_score_v2", T.DoubleType()),
    T.StructField("risk_tags", T.ArrayType(T.StringType())),
    T.StructField("why_ranked", T.StringType()),
    T.StructField("timeline_1line", T.StringType()),
    T.StructField("explode_meta", T.StringType()),
    T.StructField("run_metadata_ref", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("action_suggested", T.StringType()),
    T.StructField("reason_code", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("notes", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("reviewed_at", T.TimestampType()),
    T.StructField("label_source", T.StringType()),
])

# Column spellings met in the wild -> canonical name.
COLUMN_VARIANTS = {
    "tokens": "token",
    "outcomes": "outcome_class",
    "route_groups": "route_group",
    "event_times": "event_time",
    "dt_buckets": "dt_bucket",
}
# Names under which an event time may arrive, in order of preference.
TIME_COLUMNS = ("event_time", "event_ts", "timestamp", "start_time", "created_at", "ts")

ARRAY_COLUMNS = ("token", "outcome_class", "route_group", "event_time", "dt_bucket")

# Numeric columns of the session feature table, in output order.
OUTCOME_COUNTS = ("error", "rate_limited", "auth_fail", "guardrail_warn", "guardrail_block",
                  "bad_request", "internal_error")
ROUTE_COUNTS = ("chat", "embeddings", "models", "images", "audio", "files", "moderations",
                "batches", "assistants", "inline", "other")
GAP_COUNTS = ("t_start", "t_fast", "t_norm", "t_slow", "t_idle")
FEATURES = (
    ("n_events", "events_per_s")
    + tuple(f"n_{v}" for v in OUTCOME_COUNTS) + ("error_ratio",)
    + tuple(f"n_{v}" for v in ROUTE_COUNTS)
    + tuple(f"n_{v}" for v in GAP_COUNTS)
    + ("fast_ratio", "idle_ratio", "n_unique_tokens", "unique_token_ratio")
)
SPEC_FEATURES = ("n_events", "duration_sec", "error_rate", "rate_limited_rate", "peak30s", "route_skew")

"""The given tables seen as the inputs of this library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.sessionize import join_events, sessionize
from ..staging import materialize

START, END = "2024-01-01", "2024-02-01"
GAP_MINUTES = 1440
WINDOW_S = 21600

# Which route the k-th event asks for (k modulo 14).
ROUTES = ["/completions", "/v1/chat/completions", "/responses", "/v1/embeddings", "/models",
          "/v1/images/generations", "/audio/speech", "/v1/files", "/moderations", "/v1/batches",
          "/assistants", "/v1/threads/1", "/foo", ""]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read(spark, sf_dir, "events")
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")))


def _client() -> F.Column:
    return F.when(F.col("user_id") % 29 == 0, "").otherwise(
        F.concat(F.lit("client_"), (F.col("user_id") % 4).cast("string")))


def traces(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")
    return (events if events is not None else _events(spark, sf_dir)).select(
        F.lit("p0").alias("project_id"), F.col("event_id").cast("string").alias("id"),
        F.when(F.col("user_id") == 0, "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("k") % 10 == 0, F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("_"), week))
        .otherwise("").alias("session_id"),
        F.create_map(F.lit(C.META_CLIENT), _client()).alias("metadata"),
        F.col("ts").alias("created_at"), F.when(F.col("k") == 13, 1).otherwise(0).alias("is_deleted"))


def observations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    kind, value, k = F.col("event_type"), F.col("value"), F.col("k")
    name = (F.when(k == 99, "IGNORE_THIS")
            .when((kind == "error") & (k % 2 == 0), "internal_error")
            .when((kind == "click") & (value > 60), "rate_limit_exceed")
            .when((kind == "signup") & (value > 80), "auth_error")
            .when((kind == "purchase") & (value > 90), "guardrail_violation")
            .when((kind == "purchase") & (value > 70), "guardrail_warning")
            .when((kind == "view") & (value < 5), "bad_request_error")
            .when(k % 11 == 0, "models").otherwise("acompletion"))
    route = F.element_at(F.array(*[F.lit(r) for r in ROUTES]), k % 14 + 1)
    return (events if events is not None else _events(spark, sf_dir)).select(
        F.lit("p0").alias("project_id"), F.col("event_id").cast("string").alias("id"),
        F.col("event_id").cast("string").alias("trace_id"), F.col("ts").alias("created_at"),
        F.concat(F.lit("litellm-"), name).alias("name"),
        F.when(kind == "error", "ERROR").otherwise("DEFAULT").alias("level"),
        F.create_map(F.lit(C.META_CLIENT), F.when(k % 17 == 0, "").otherwise(_client()),
                     F.lit(C.META_ROUTE), route).alias("metadata"),
        F.when(k == 13, 1).otherwise(0).alias("is_deleted"), k)


def base_events(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    ev = _events(spark, sf_dir)
    return join_events(traces(spark, sf_dir, ev), observations(spark, sf_dir, ev), START, END, extra=extra)


def one_project(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The base events without their project: most queries show sessions of one project, whose keys do not name it."""
    return base_events(spark, sf_dir, extra).drop("project_id")


def two_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base events, and those of every other user a week later once more as another project."""
    base = base_events(spark, sf_dir)
    other = base.where(F.col("user_id").cast("long") % 2 == 0).withColumns({"project_id": F.lit("p1"), "event_time": F.col("event_time") + F.expr("INTERVAL 7 DAYS")})
    return base.unionByName(other)


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = materialize(make(), name)
    return _STAGED[key]


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events with the number `k` of their row, from which signals are made."""
    return staged(spark, sf_dir, "session-events", lambda: sessionize(one_project(spark, sf_dir, ("k",)), GAP_MINUTES))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessionised events, written once per application: everything after sessionising reads this table."""
    return numbered_events(spark, sf_dir).drop("k")


def weekly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events with `day` holding the Monday of the session's week: five comparable periods."""
    monday = F.date_format(F.date_trunc("week", "session_start"), "yyyy-MM-dd")
    return session_events(spark, sf_dir).withColumn("day", monday)

"""Writing results, and the records that describe a run."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import REVIEW_LOG


def _nested(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its path objects."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the finished folder `fresh` in the place of `path`; what was there goes last."""
    fs, make = _files(spark, path)
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    if not fs.rename(make(path), make(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(make(fresh), make(path)):
        fs.rename(make(old), make(path))
        raise OSError(f"cannot put the new table at {path}")
    fs.delete(make(old), True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), overwrite: bool = False,
                allow_empty: bool = False) -> None:
    """Write parquet (zstd), CSV or JSON lines. Refuses existing targets unless told otherwise, and empty input.

    Emptiness is seen while writing, by a counter on the rows, so the input is not computed twice. An overwrite is written
    beside the target, which it replaces when all rows are written: a job that fails leaves the old rows. Rows of one
    partition value come from a few tasks.
    """
    spark = df.sparkSession
    fs, make = _files(spark, path)
    replaces = overwrite and fs.exists(make(path))
    target = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}" if replaces else path
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        out = out.select(*[F.to_json(f.name).alias(f.name) if _nested(f.dataType) else F.col(f.name) for f in df.schema.fields])
    writer = out.write.mode("errorifexists")
    if partition_by:
        writer = out.hint("rebalance", *partition_by).write.mode("errorifexists").partitionBy(*partition_by)
    try:
        if fmt == "csv":
            writer.option("header", "true").csv(target)
        elif fmt == "json":
            writer.json(target)
        else:
            writer.option("compression", "zstd").parquet(target)
        if not allow_empty and not seen.get.get("rows", 0):
            raise ValueError(f"nothing to write to {path}: the input is empty" + (", what is there stays" if replaces else ""))
    except Exception:
        if replaces:
            fs.delete(make(target), True)
        raise
    if replaces:
        _swap(spark, target, path)


def write_sessions(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Sessions or features, one folder per day."""
    write_table(df, path, partition_by=("day",), overwrite=overwrite)


def write_token_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Token tables by client and version; all clients in one job."""
    write_table(df, path, partition_by=("client_name", "version"), overwrite=overwrite)


def schema_manifest(df: DataFrame, notes: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column: name, type, nullable, note."""
    notes = notes or {}
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, notes.get(f.name, "")) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean, note string")


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()[:16]


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free hashes of the rows, with a hash of the schema; any change of data changes it.

    Equal rows cancel in the xor, so their sum is kept beside it.
    """
    h = F.xxhash64(*[F.to_json(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"),
                  F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("sum_hash")
                  ).withColumn("schema_hash", F.lit(schema_hash(df)))


def run_metadata(spark: SparkSession, run: str, params: Mapping[str, object], counts: Mapping[str, int],
                 seconds: Mapping[str, float] | None = None, policies: Mapping[str, str] | None = None, build: str = "") -> DataFrame:
    """One row about a run. Counts come from `observe()` on the tables while they were written."""
    row = (run, build, json.dumps(dict(params), sort_keys=True, default=str), dict(counts),
           {k: float(v) for k, v in (seconds or {}).items()}, dict(policies or {}))
    return spark.createDataFrame([row], "run string, build string, params string, counts map<string,bigint>, "
                                 "seconds map<string,double>, policies map<string,string>").withColumn("generated_at", F.current_timestamp())


def empty_review_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REVIEW_LOG)


def append_reviews(df: DataFrame, path: str) -> None:
    """Append decisions to the review log; columns of the log that are missing become null."""
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in REVIEW_LOG.fields]
    df.select(*cols).write.mode("append").parquet(path)

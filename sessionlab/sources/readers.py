"""Reading tables: several files with differing schemas, column pruning, client lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest common type: the wider number, timestamps over dates, arrays by element, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _NUMBERS and type(b) in _NUMBERS:
        if {type(a), type(b)} == {T.LongType, T.FloatType}:
            return T.DoubleType()
        return max(a, b, key=lambda t: _NUMBERS.index(type(t)))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return max(a, b, key=lambda t: times.index(type(t)))
    return T.StringType()


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name: missing columns are null, columns of differing types become the wider type."""
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    cast = [df.select(*[F.col(f.name).cast(types[f.name]).alias(f.name) for f in df.schema.fields]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def _base(path: str) -> str:
    """The folder above the first wildcard, below which folders named column=value are columns."""
    parts = path.split("/")
    fixed = next((i for i, part in enumerate(parts) if any(c in part for c in "*?[{")), None)
    return path if fixed is None else "/".join(parts[:fixed])


def _alike(spark: SparkSession, base: str, files: list[str]) -> list[DataFrame]:
    """Scans of stretches of `files` whose schemas can be merged. Spark reads the footers of a stretch in one job; a stretch that fails is halved."""
    try:
        return [spark.read.option("mergeSchema", "true").option("basePath", base).parquet(*files)]
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e) or len(files) == 1:
            raise
    half = len(files) // 2
    return _alike(spark, base, files[:half]) + _alike(spark, base, files[half:])


def _scans(spark: SparkSession, path: str) -> list[DataFrame]:
    """One scan of a path or glob; if its files differ in the types of a column, one scan per stretch of files that agree.

    Every listed file is read, whatever its name; Spark leaves out names that begin with a dot or an underscore.
    """
    try:
        return [spark.read.option("mergeSchema", "true").parquet(path)]
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").sort("path").collect()
    return _alike(spark, _base(path), [row.path for row in listed])


def read_tables(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str] | None = None,
                clients: Sequence[str] | None = None) -> DataFrame:
    """Parquet from one or several paths or globs, which may differ in columns and types."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = [df for p in paths for df in _scans(spark, p)]
    df = frames[0] if len(frames) == 1 else union_relaxed(frames)
    if clients:
        df = df.where(F.col("client_name").isin(list(clients)))
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, start: str, end: str, partitions: int = 64, **options: str) -> DataFrame:
    """A log table behind JDBC, cut to a time range and read in `partitions` slices of it."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="created_at", lowerBound=start,
                                               upperBound=end, numPartitions=str(partitions), **options)
    t = F.col("created_at")
    return reader.load().where((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))

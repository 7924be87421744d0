"""Readers for log files and run tables, in batch and as streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from logfold.operators.shaping import path_tag, skip_long_lines

EVENT_SCHEMA = StructType([StructField(name, StringType()) for name in (
    "level", "component", "message", "entity", "event_id", "pod", "namespace", "timestamp", "trace_id")])

RUN_SCHEMA = StructType([
    StructField("pipeline", StringType()), StructField("workload_id", IntegerType()),
    StructField("dup_ratio", DoubleType()), StructField("seed", LongType()),
    StructField("N", LongType()), StructField("M", LongType()),
    StructField("storage", LongType()), StructField("total_storage", LongType()),
    StructField("reconstructed", LongType()), StructField("failed", StringType()),
    StructField("settled", BooleanType()), StructField("timestamp", StringType())])

# The container runtime's stream names and file name format.
CRI_STREAMS = ("stdout", "stderr")
LOG_FILE = r"([^/_]+)_([^/_]+)_([^/]+)-([^/-]+)\.log$"
WORKLOAD_GLOB = "log-workload-*_default_emitter-*.log"


def read_json_logs(spark: SparkSession, path: str, schema: StructType = EVENT_SCHEMA) -> DataFrame:
    """JSON lines; a line that does not parse is kept in ``_corrupt``."""
    full = StructType(schema.fields + [StructField("_corrupt", StringType())])
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def parse_cri(lines: DataFrame, column: str = "value") -> DataFrame:
    """Split container log lines into time, stream, logtag and log.

    The first three fields hold no blank, so a four-way split does it without a regex. A line
    of another format is kept whole in ``log``, with ``parsed`` false and the other fields NULL.
    Digits below a microsecond are cut off.
    """
    part = F.col("_parts")
    rest = [c for c in lines.columns if c != column]
    fits = F.coalesce((F.size(part) == 4) & (F.get(part, F.lit(0)) != "") & F.get(part, F.lit(1)).isin(*CRI_STREAMS), F.lit(False))
    field = lambda i: F.when(F.col("parsed"), F.get(part, F.lit(i)))
    return (lines.withColumn("_parts", F.split(column, " ", 4)).withColumn("parsed", fits)
            .select(*rest, field(0).try_cast("timestamp").alias("time"), field(1).alias("stream"),
                    field(2).alias("logtag"), F.coalesce(field(3), F.col(column)).alias("log"), "parsed"))


def file_fields(path: Column) -> dict[str, Column]:
    """Pod, namespace, container and container id from a log file name."""
    return {name: F.nullif(F.regexp_extract(path, LOG_FILE, i), F.lit("")) for i, name in enumerate(
        ("pod_name", "namespace_name", "container_name", "container_id"), start=1)}


def _with_file(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select("*", path_tag(path).alias("tag"), F.struct(
        *[c.alias(n) for n, c in file_fields(path).items()]).alias("kubernetes"))


def read_cri_logs(spark: SparkSession, path: str, glob: str = "*.log",
                  max_line_bytes: int | None = None) -> DataFrame:
    lines = _with_file(spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path))
    if max_line_bytes is not None:
        lines = skip_long_lines(lines, max_line_bytes)
    return parse_cri(lines)


def read_docker_logs(spark: SparkSession, path: str, extra: StructType | None = None) -> DataFrame:
    """JSON lines whose ``time`` is the event time; log and stream are the usual other fields.

    A time without a zone is UTC. A line that does not parse is kept in ``_corrupt``.
    """
    schema = extra or StructType([StructField("log", StringType()), StructField("stream", StringType())])
    full = StructType([StructField("time", StringType()), *schema.fields, StructField("_corrupt", StringType())])
    raw = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    zoned = F.when(F.col("time").rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.col("time")).otherwise(
        F.concat("time", F.lit("Z")))
    return raw.withColumn("time", zoned.try_cast("timestamp"))


def stream_logs(spark: SparkSession, path: str, glob: str = WORKLOAD_GLOB, files_per_trigger: int = 1000,
                max_line_bytes: int | None = None) -> DataFrame:
    """Container logs as a stream of new files, parsed and tagged like the batch reader.

    The query's checkpoint keeps the file offsets. Files must appear whole.
    """
    lines = _with_file(spark.readStream.format("text").option("pathGlobFilter", glob)
                       .option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).load(path))
    if max_line_bytes is not None:
        lines = skip_long_lines(lines, max_line_bytes)
    return parse_cri(lines)


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a folder of run tables by their header line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("n"))
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))
    return {r["head"]: r["files"] for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()}


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run tables with a header; columns that older files lack come back as NULL.

    Files with other columns, or the same in another order, are each read by their own header. Numbers are
    read as text first, since counts may carry a fraction or be blank.
    """
    parts = [_typed_runs(spark.read.option("header", True).csv(files)) for files in _headers(spark, path).values()]
    if not parts:
        return spark.createDataFrame([], RUN_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def _typed_runs(raw: DataFrame) -> DataFrame:
    columns = []
    for item in RUN_SCHEMA.fields:
        if item.name not in raw.columns:
            columns.append(F.lit(None).cast(item.dataType).alias(item.name))
            continue
        value = F.trim(F.col(item.name))
        if item.name == "settled":
            value = F.lower(value) != "false"
        exact = value.try_cast(item.dataType)
        if isinstance(item.dataType, (IntegerType, LongType)):  # a double holds whole numbers up to 2^53 only
            exact = F.coalesce(exact, value.try_cast("double").try_cast(item.dataType))
        columns.append(exact.alias(item.name))
    return raw.select(*columns)


def write_csv(df: DataFrame, path: str, files: int | None = 1) -> None:
    """A table as CSV with a header: summaries in one file, larger tables in ``files`` of them, or as they come (None)."""
    table = df if files is None else df.coalesce(1) if files == 1 else df.repartition(files)
    table.write.mode("overwrite").option("header", True).csv(path)

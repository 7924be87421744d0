"""Append and keyed tables as Parquet folders, with compaction and storage measures.

A keyed table is a folder of deltas, ``batch=<id>``. An upsert writes only the keys it
touches, so its cost follows the batch and not the table; writing a batch again replaces
it. Readers take the latest row of each key. Compaction writes that view to a new folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logfold.operators.ranking import pick_rows
from logfold.session import scratch_path

TARGET_BYTES = 512 * 1024 * 1024


def append_records(df: DataFrame, path: str) -> None:
    """Add every record to an append table."""
    df.write.mode("append").parquet(path)


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; combined before the shuffle."""
    return pick_rows(df, key, order).select(*df.columns)


def upsert(snapshot: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Insert or replace by key, the later row by ``order`` wins.

    Union and aggregate instead of a full outer join: rows of a hot key are combined before
    they are shuffled, and applying a batch twice changes nothing.
    """
    return latest(snapshot.unionByName(batch), key, order)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Store the rows one batch touched; repeating a batch id replaces its rows."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All stored rows with their ``batch``, superseded ones included."""
    return spark.read.schema(StructType(schema.fields + [StructField("batch", LongType())])).parquet(path)


def read_latest(spark: SparkSession, path: str, schema: StructType, key: str = "_agg_id",
                order: Sequence[str] = ("batch",)) -> DataFrame:
    return latest(read_batches(spark, path, schema), key, order).drop("batch")


def storage_files(spark: SparkSession, path: str) -> DataFrame:
    """Data files below a folder with their length; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").load(path).select("path", "length"))


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: number of files and bytes of a table, or of all tables below a folder."""
    return storage_files(spark, path).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def compact_table(spark: SparkSession, source: str, target: str, schema: StructType, key: str = "_agg_id",
                  order: Sequence[str] = ("batch",), target_bytes: int = TARGET_BYTES) -> int:
    """Write the latest rows to a new folder in files of about ``target_bytes``.

    The rows are written once to learn their size without the superseded ones, then in as many
    files as that needs. Returns the number of files asked for.
    """
    whole = scratch_path(spark, "latest")
    rows = read_latest(spark, source, schema, key, order)
    rows.write.parquet(whole)
    files = max(1, -(-storage_stats(spark, whole).first()["bytes"] // target_bytes))
    stored = spark.read.schema(rows.schema).parquet(whole)
    write_batch(stored.coalesce(1) if files == 1 else stored.repartition(files, key), target, 0)
    return files


def settle_check(spark: SparkSession, path: str, schema: StructType, key: str = "_agg_id",
                 target_bytes: int = TARGET_BYTES) -> DataFrame:
    """One row: is the table fully compacted, so that its size may be compared?

    A compacted table has no superseded rows and no more files than its size needs.
    """
    per_key = read_batches(spark, path, schema).groupBy(key).agg(F.count("*").alias("n"))
    rows = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("docs"))
    both = storage_stats(spark, path).unionByName(rows, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("files", "bytes", "rows", "docs")])
    return both.select(
        "files", "bytes", "docs", (F.col("rows") - F.col("docs")).alias("superseded"),
        ((F.col("files") <= F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes))) & (F.col("rows") == F.col("docs"))).alias("settled"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write a snapshot in ``buckets`` buckets of its key, one sorted file each, and open it.

    Rows that already come in as many partitions by key, as ``upsert_bucketed`` gives them, are not moved.
    """
    spark = df.sparkSession
    name = f"snapshot_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, key)
    placed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """Open a bucketed snapshot of another session: the folder itself does not say how it is bucketed."""
    name = f"snapshot_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def upsert_bucketed(snapshot: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Insert or replace by key in a bucketed snapshot, the later row by ``order`` wins, of equal ones the batch's.

    The batch is combined by key and meets the snapshot bucket by bucket, so only the batch is shuffled: once, if there are as
    many buckets as shuffle partitions. Keys are never NULL.
    """
    columns = snapshot.columns
    payload = [c for c in columns if c != key]
    checked = F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} of an upsert is NULL")).cast(batch.schema[key].dataType))
    newest = batch.groupBy(checked.alias(key)).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_new"))
    old = snapshot.select(key, F.struct(*payload).alias("_old"))
    rank = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in order])
    wins = F.col("_old").isNull() | (F.col("_new").isNotNull() & (rank("_new") >= rank("_old")))
    met = old.join(newest, key, "full_outer").select(key, F.when(wins, F.col("_new")).otherwise(F.col("_old")).alias("_row"))
    return met.select(key, "_row.*").select(*columns)

"""Keyed tables that are written and read at the same time.

A table is a folder of Parquet folders and one small file, ``_current``, that names the folders which make up the
table. A batch writes a folder of its own and then replaces that file in one rename, so a reader sees all of a batch
or none of it. Batches are merged now and then: a merge takes the newest folders for as long as the next older one is
not much larger than what is merged already, so folder sizes grow geometrically, a row is rewritten a logarithmic
number of times, and a reader opens a logarithmic number of folders. Folders that a merge replaced stay for
``keep`` more batches, for readers that opened them before.

There is one writer, the stream. A batch that is repeated replaces its folder. A folder that a lost writer left behind
is named nowhere and goes with the next merge.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logfold.operators.tables import latest, storage_stats

POINTER = "_current"
MERGE_EVERY, KEEP, GROWTH = 20, 20, 2


def _paths(spark: SparkSession, *paths: str) -> tuple:
    """Hadoop's file context and path objects, for files that only Spark's storage layer reaches."""
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made[0].toUri(), spark._jsc.hadoopConfiguration()), *made


def _read_pointer(spark: SparkSession, path: str) -> dict:
    context, file = _paths(spark, f"{path}/{POINTER}")
    if not context.util().exists(file):
        return {"live": [], "old": []}
    with_file = context.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(with_file, "UTF-8"))
    finally:
        with_file.close()


def _swap_pointer(spark: SparkSession, path: str, state: dict) -> None:
    context, folder, new, file = _paths(spark, path, f"{path}/{POINTER}-{uuid.uuid4().hex}", f"{path}/{POINTER}")
    options = spark._jvm.org.apache.hadoop.fs.Options
    flags = spark._jvm.java.util.EnumSet.of(spark._jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    parent = options.CreateOpts.createParent()
    create = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    create[0] = parent
    out = context.create(new, flags, create)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    rename = spark._sc._gateway.new_array(options.Rename, 1)
    rename[0] = options.Rename.OVERWRITE
    context.rename(new, file, rename)


def live_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the table now, oldest first."""
    return [f"{path}/{name}" for name in _read_pointer(spark, path)["live"]]


def _with_batch(schema: StructType) -> StructType:
    return StructType(schema.fields + [StructField("batch", LongType())])


def read_published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the table as it is now with their ``batch``, superseded ones included.

    The folders are fixed when this is called; later batches and merges do not change what the frame holds.
    """
    folders = live_folders(spark, path)
    if not folders:
        return spark.createDataFrame([], _with_batch(schema))
    return spark.read.schema(_with_batch(schema)).parquet(*folders)


def read_current(spark: SparkSession, path: str, schema: StructType, key: str = "_agg_id", order: Sequence[str] = ("batch",)) -> DataFrame:
    """The latest row of each key."""
    return latest(read_published(spark, path, schema), key, order).drop("batch")


def publish_batch(batch: DataFrame, path: str, batch_id: int, key: str = "_agg_id", order: Sequence[str] = ("batch",),
                  merge_every: int = MERGE_EVERY, keep: int = KEEP) -> None:
    """Add the rows one batch touched, at once; merge the newest folders every ``merge_every`` batches."""
    spark = batch.sparkSession
    state = _read_pointer(spark, path)
    name = f"batch-{batch_id}-{uuid.uuid4().hex}"
    rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.parquet(f"{path}/{name}")
    # a repeated batch replaces its folder; one that has been merged already is the same rows again, which changes nothing
    again = [f for f in state["live"] if f.startswith(f"batch-{batch_id}-")]
    live = [f for f in state["live"] if f not in again] + [name]
    old = [x for x in state["old"] if x[1] > batch_id - keep] + [[f, batch_id] for f in again]
    if sum(f.startswith("batch-") for f in live) >= merge_every:
        merged = _newest(spark, path, live)
        if len(merged) > 1:
            whole = f"merged-{batch_id}-{uuid.uuid4().hex}"
            latest(spark.read.schema(_with_batch(batch.schema)).parquet(*[f"{path}/{f}" for f in merged]), key, order).write.parquet(f"{path}/{whole}")
            live = [f for f in live if f not in merged] + [whole]
            old += [[f, batch_id] for f in merged]
    _swap_pointer(spark, path, {"live": live, "old": old})
    if live[-1].startswith("merged-"):
        _remove_others(spark, path, {POINTER, *live, *(f for f, _ in old)})


def _newest(spark: SparkSession, path: str, live: list[str]) -> list[str]:
    """The folders to merge: all single batches, and older merges while they are not much larger than what is taken."""
    singles = [f for f in live if f.startswith("batch-")]
    taken, size = singles, sum(_bytes(spark, f"{path}/{f}") for f in singles)
    for folder in reversed([f for f in live if not f.startswith("batch-")]):
        own = _bytes(spark, f"{path}/{folder}")
        if own > GROWTH * size:
            break
        taken, size = [folder, *taken], size + own
    return taken


def _bytes(spark: SparkSession, path: str) -> int:
    return storage_stats(spark, path).first()["bytes"]


def _remove_others(spark: SparkSession, path: str, named: set[str]) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for item in system.listStatus(folder):
        name = item.getPath().getName()
        if name.startswith(("batch-", "merged-", POINTER)) and name not in named:
            system.delete(item.getPath(), True)

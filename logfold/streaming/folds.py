"""Folding streams of records that carry a signature column.

What a strategy knows of a signature lives in Spark's own state store, keyed by signature, so a batch reads and
writes the keys it touches and nothing else, and a restart from the checkpoint neither loses nor doubles anything.
Records are ordered by their own order columns within a batch; batches follow each other. Sort keys are compared with
NULL first, as in batch.

The record-level fold holds one batch's records of one signature in a task: bound a batch (``files_per_trigger`` of
the source), which bounds its hottest signature too. The other folds hold one record per signature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from logfold.functions.masking import tag_record
from logfold.functions.schedule import DEFAULT_EPS
from logfold.operators.published import KEEP, MERGE_EVERY, publish_batch, read_current
from logfold.operators.ranking import pick_rows
from logfold.session import ROCKSDB, scratch_scope

#: What the state holds of a signature: its records so far and the count it was last emitted with.
STATE = StructType([StructField("n", LongType()), StructField("emitted", LongType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Order of the stored documents: the larger count is the later one.
LATER = ("count", "batch")


def document_schema(df: DataFrame, sig: str = "sig") -> StructType:
    """Schema of the aggregated documents that a record frame folds into."""
    return tag_record(df, sig, F.lit(0)).schema


def next_emission(emitted: int, eps: float) -> int:
    """The count of the emission after the one at count ``emitted`` (0: none yet); there is no last one."""
    if emitted == 0:
        return 1
    return max(emitted + 1, math.ceil(emitted * (1 + eps))) if eps > 0 else emitted + 1


def _sort_key(order: Sequence[str], row: Row) -> tuple:
    return tuple((row[c] is not None, row[c]) for c in order)


class _Fold(StatefulProcessor):
    """Keeps (n, emitted) of each signature."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], eps: float):
        self.columns, self.order, self.eps = list(columns), list(order), eps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", STATE)

    def load(self) -> tuple[int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0)

    def emit(self, row: Row, count: int) -> Row:
        return Row(*self.columns, "_n")(*[row[c] for c in self.columns], count)

    def close(self) -> None:
        pass


class EveryRecord(_Fold):
    """Emits the records whose number is due: the first, then whenever the count has grown by ``eps``."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, emitted = self.load()
        ordered = sorted(rows, key=partial(_sort_key, self.order))
        upto, due = before + len(ordered), next_emission(emitted, self.eps)
        while due <= upto:
            yield self.emit(ordered[due - before - 1], due)
            emitted, due = due, next_emission(due, self.eps)
        self.state.update((upto, emitted))


class LastRecord(_Fold):
    """Emits a signature's last record of the batch, with the last count that was due, if one became due."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, emitted = self.load()
        last, last_key, stored = None, None, emitted
        for row in rows:  # one record is held, however many there are
            n += 1
            own = _sort_key(self.order, row)
            if last is None or own > last_key:
                last, last_key = row, own
        due = next_emission(emitted, self.eps)
        while due <= n:
            emitted, due = due, next_emission(due, self.eps)
        self.state.update((n, emitted))
        if emitted > stored:
            yield self.emit(last, emitted)


def _folded(stream: DataFrame, processor: type[_Fold], order: Sequence[str], eps: float, sig: str) -> DataFrame:
    """The stream's emissions with their ``_n``, by a processor over Spark's state store (RocksDB, which it needs)."""
    stream.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    out = StructType(stream.schema.fields + [StructField("_n", LongType())])
    return stream.groupBy(sig).transformWithState(processor(stream.columns, order, eps), out, "Append", "none")


def _start(frame: DataFrame, sink, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    return (frame.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _upsert(path: str, sig: str, merge_every: int, keep: int):
    def sink(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            publish_batch(tag_record(batch, sig, F.col("_n")).drop("_n"), path, batch_id, "_agg_id", LATER, merge_every, keep)
    return sink


def fold_counts(stream: DataFrame, path: str, checkpoint: str, order: Sequence[str], sig: str = "sig",
                trigger: dict | None = None, merge_every: int = MERGE_EVERY, keep: int = KEEP) -> StreamingQuery:
    """Exact running counts: each batch upserts the documents of the signatures it touched.

    Counting is a streaming aggregate, partly aggregated before its shuffle, so a hot
    signature costs one row per task.
    """
    return _start(pick_rows(stream, sig, order, count="_n"), _upsert(path, sig, merge_every, keep), checkpoint, "update", trigger)


def fold_bounded(stream: DataFrame, path: str, checkpoint: str, order: Sequence[str],
                 eps: float = DEFAULT_EPS, sig: str = "sig", trigger: dict | None = None,
                 merge_every: int = MERGE_EVERY, keep: int = KEEP) -> StreamingQuery:
    """Bounded re-emission per batch: upsert a signature only when its schedule value moved."""
    return _start(_folded(stream, LastRecord, order, eps, sig), _upsert(path, sig, merge_every, keep), checkpoint, "append", trigger)


def fold_emissions(stream: DataFrame, path: str, checkpoint: str, order: Sequence[str],
                   eps: float = DEFAULT_EPS, sig: str = "sig", trigger: dict | None = None) -> StreamingQuery:
    """Bounded re-emission record by record; emitted records are appended to ``path`` by Spark's file sink.

    Which records are emitted does not depend on how they are cut into batches.
    """
    emitted = _folded(stream, EveryRecord, order, eps, sig)
    return append_stream(tag_record(emitted, sig, F.col("_n")).drop("_n"), path, checkpoint, trigger)


def read_emitted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All records emitted so far; the sink's own log tells which files count."""
    return spark.read.schema(schema).parquet(path)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The keyed table behind a folded stream: the latest document of each signature."""
    return read_current(spark, path, schema, "_agg_id", LATER)


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Strategy A on a stream: append every record."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())

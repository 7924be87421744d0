"""Growth of one shared store, one workload at a time.

``add_workload`` folds the log of the new workload only. What earlier workloads left is a set of seen signatures with
the size of their documents, and one row of totals per workload; their logs are not read again. Both tables are
published by a pointer (``operators/published.py``), the totals last, so a workload counts once its totals are there.
Adding a workload again after a failure replaces what it had written. Workloads are added in the order of their ids, by
one writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logfold.operators.published import publish_batch, read_current, read_published
from logfold.operators.ranking import running_sums
from logfold.plans.runs import TAG_BYTES
from logfold.session import materialize

SEEN = StructType([StructField("sig", StringType()), StructField("doc_bytes", LongType())])
STEPS = StructType([StructField("workload_id", LongType()), *(
    StructField(name, LongType()) for name in ("N", "all_bytes", "new_docs", "new_bytes"))])


def add_workload(log: DataFrame, path: str, workload_id: int, sig: str = "sig", size: str = "bytes") -> None:
    """Add the records of one workload to the store below ``path``. A log without records adds a row of zeros."""
    spark = log.sparkSession
    last = read_current(spark, f"{path}/steps", STEPS, "workload_id").agg(F.max("workload_id")).first()[0]
    if last is not None and workload_id < last:
        raise ValueError(f"workload {workload_id} comes after {last}; workloads are added in order")
    folded = materialize(log.groupBy(F.col(sig).alias("sig")).agg(
        F.count("*").alias("n"), F.sum(size).cast("long").alias("all_bytes"), F.max(size).cast("long").alias("doc_bytes")), "folded")
    earlier = read_published(spark, f"{path}/seen", SEEN).where(F.col("batch") != workload_id).select("sig")
    # the new workload is the small side: the large set is cut down to it first, without a shuffle where it fits
    known = earlier.join(folded.select("sig"), "sig", "left_semi")
    fresh = materialize(folded.join(known, "sig", "left_anti").select("sig", "doc_bytes"), "fresh")
    publish_batch(fresh, f"{path}/seen", workload_id, "sig")
    stored = (F.col("doc_bytes") + 2 * F.octet_length("sig") + TAG_BYTES).alias("new_bytes")
    none = F.lit(0).cast("long")
    parts = folded.select(F.col("n").alias("N"), "all_bytes", none.alias("new_docs"), none.alias("new_bytes")).unionByName(
        fresh.select(none.alias("N"), none.alias("all_bytes"), F.lit(1).cast("long").alias("new_docs"), stored))
    step = parts.agg(*(F.coalesce(F.sum(c), none).alias(c) for c in parts.columns))
    step = step.select(F.lit(workload_id).cast("long").alias("workload_id"), "*")
    publish_batch(step, f"{path}/steps", workload_id, "workload_id")


def grown(spark: SparkSession, path: str) -> DataFrame:
    """pipeline, workload_id, N, M and total_storage after each workload, from the totals alone."""
    steps = read_current(spark, f"{path}/steps", STEPS, "workload_id")
    rows = F.explode(F.array(
        F.struct(F.lit("A").alias("pipeline"), F.col("N").alias("docs"), F.col("all_bytes").alias("added")),
        *(F.struct(F.lit(name).alias("pipeline"), F.col("new_docs").alias("docs"), F.col("new_bytes").alias("added")) for name in ("B", "C"))))
    each = materialize(steps.select("workload_id", "N", rows.alias("_row")).select("workload_id", "N", "_row.*"), "steps")
    out = running_sums(each, ["pipeline"], ["workload_id"], {"M": "docs", "total_storage": "added"})
    return out.select("pipeline", "workload_id", "N", "M", "total_storage")

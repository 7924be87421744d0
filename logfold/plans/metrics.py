"""Run tables to per-run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions import scalars as S
from logfold.operators.ranking import HOT_ROWS, group_median, join_back, join_small

# Fixed value: bytes per document beyond this multiple of the pipeline's median are an artifact.
OUTLIER_FACTOR = 1.5
BASELINE = "A"


def flag_storage(runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add bytes_per_doc, bloat against the pipeline's median, and storage_valid."""
    settled = F.col("settled") if "settled" in runs.columns else F.lit(None).cast("string")
    sized = runs.withColumn("bytes_per_doc", S.bytes_per_doc(F.col("storage"), F.col("M")))
    medians = group_median(sized, ["pipeline"], "bytes_per_doc", "_median", hot_rows)
    bloated = join_small(sized, medians, ["pipeline"], "left").withColumn(
        "bloat", F.try_divide("bytes_per_doc", "_median")).drop("_median")
    return bloated.withColumn(
        "storage_valid", S.is_settled(settled) & F.coalesce(F.col("bloat") <= OUTLIER_FACTOR, F.lit(False)))


def _reconstructed(runs: DataFrame) -> Column:
    if "reconstructed" not in runs.columns:
        return F.col("M")
    return F.coalesce(F.col("reconstructed"), F.col("M"))


def run_metrics(runs: DataFrame, extra: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fifteen metric columns per run, as one plan; ``extra`` run columns are passed on."""
    flagged = flag_storage(runs, hot_rows)
    stamp = F.col("timestamp") if "timestamp" in runs.columns else F.lit(None).cast("string")
    base = (flagged.where((F.col("pipeline") == BASELINE) & F.col("storage_valid"))
            .groupBy("workload_id")
            .agg(F.max_by("storage", F.struct(stamp.alias("t"), "storage")).alias("_base")))
    joined = join_back(flagged, base, ["workload_id"], "left")
    recon = _reconstructed(runs)
    return joined.select(
        "pipeline", "workload_id", "dup_ratio", S.category(F.col("dup_ratio")).alias("category"), "N", "M",
        recon.alias("reconstructed"), "storage", "storage_valid", "bytes_per_doc", "bloat",
        S.storage_reduction(F.col("storage"), F.col("_base"), F.col("storage_valid")).alias("SRR"),
        F.col("dup_ratio").alias("SRR_theoretical"),
        S.ratio_or_zero(F.col("N"), F.col("M")).alias("CE"),
        S.preserved(recon, F.col("N")).alias("IPR"), *extra)

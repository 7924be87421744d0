"""Report tables over run metrics, series in the order they are drawn.

Rendering is left to the reader's tool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.functions import scalars as S
from logfold.operators.ranking import (CHUNK_ROWS, HOT_ROWS, chunk_window, join_back, join_small,
                                       rank_rows, with_neighbours)
from logfold.plans.metrics import BASELINE, OUTLIER_FACTOR
from logfold.plans.runs import PIPELINES
from logfold.session import materialize

CATEGORIES = ("low", "med", "high")
GROUP = ["pipeline", "category"]


def mean_ipr(metrics: DataFrame, by: list[str], name: str) -> DataFrame:
    return metrics.groupBy(*by).agg(F.avg("IPR").alias(name))


def failure_impact(normal: DataFrame, failure: DataFrame | None) -> DataFrame:
    """Mean preservation per pipeline without and with failures; NULL where there are no runs."""
    result = mean_ipr(normal, ["pipeline"], "ipr_normal")
    if failure is None:
        return result.withColumn("ipr_failure", F.lit(None).cast("double"))
    return join_back(result, mean_ipr(failure, ["pipeline"], "ipr_failure"), ["pipeline"], "left")


def with_failure(normal: DataFrame, failure: DataFrame) -> DataFrame:
    """Each normal run beside the failure run of the same pipeline and workload."""
    other = failure.select("pipeline", "workload_id", F.col("IPR").alias("IPR_failure"))
    joined = join_back(normal, other, ["pipeline", "workload_id"], "left")
    return joined.withColumn("FLR", F.col("IPR") - F.col("IPR_failure")).withColumn(
        "loss_failure", 1 - F.col("IPR_failure"))


def tradeoff(normal: DataFrame, failure: DataFrame) -> DataFrame:
    """Storage saved against loss under failure, for runs with a defined saving.

    ``FLR`` is the difference of the two preservation ratios, ``loss_failure`` is one minus
    preservation under failure; the two differ where the normal run loses something too.
    """
    return with_failure(normal, failure).where(F.col("SRR").isNotNull()).select(
        "pipeline", "workload_id", "SRR", "FLR", "loss_failure")


def srr_by_dup(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("SRR").isNotNull()).select(
        "pipeline", "workload_id", S.percent(F.col("dup_ratio")).alias("dup_pct"),
        S.percent(F.col("SRR")).alias("srr_pct"),
        S.percent(F.col("SRR_theoretical")).alias("srr_theoretical_pct")).orderBy(
        "pipeline", "dup_pct", "workload_id")


def storage_line(metrics: DataFrame) -> DataFrame:
    return metrics.select("pipeline", "workload_id", S.megabytes(F.col("storage")).alias("storage_mb"),
                          F.col("storage_valid").alias("included")).orderBy("pipeline", "workload_id")


def exclusion_report(metrics: DataFrame) -> DataFrame:
    """One row per excluded run, labelled, with the counts of its pipeline and of all runs."""
    counts = metrics.groupBy("pipeline").agg(
        F.count_if(~F.col("storage_valid")).alias("excluded"), F.count("*").alias("runs"))
    excluded = metrics.where(~F.col("storage_valid")).select(
        "pipeline", "workload_id", F.round("bloat", 1).alias("bloat"),
        F.lower(F.format_string("wl%d(%.1fx)", F.col("workload_id").cast("long"),
                                F.coalesce("bloat", F.lit(float("nan"))))).alias("label"))
    return join_small(excluded, counts, ["pipeline"]).withColumn("factor", F.lit(OUTLIER_FACTOR))


def exclusion_summary(metrics: DataFrame) -> DataFrame:
    """Excluded and all runs of every pipeline, clean ones included, and of ``all`` together."""
    counts = materialize(metrics.groupBy("pipeline").agg(
        F.count_if(~F.col("storage_valid")).alias("excluded"), F.count("*").alias("runs")), "exclusions")
    both = counts.unionByName(counts.agg(F.lit("all").alias("pipeline"), F.sum("excluded").alias("excluded"), F.sum("runs").alias("runs")))
    return both.withColumn("merged", F.col("excluded") == 0)


def category_grid(metrics: DataFrame) -> DataFrame:
    """All pipelines and categories, whether or not there are runs: nine fixed rows."""
    cells = [(p, c) for p in PIPELINES for c in CATEGORIES]
    return metrics.sparkSession.createDataFrame(cells, "pipeline string, category string")


def ipr_grid(normal: DataFrame, failure: DataFrame | None) -> DataFrame:
    """Mean preservation per pipeline and category; cells without runs are 0."""
    grid = join_back(category_grid(normal), mean_ipr(normal, GROUP, "normal"), GROUP, "left")
    if failure is None:
        return grid.na.fill(0.0, ["normal"]).withColumn("failure", F.lit(None).cast("double"))
    return join_back(grid, mean_ipr(failure, GROUP, "failure"), GROUP, "left").na.fill(0.0, ["normal", "failure"])


def ipr_vs_dup(normal: DataFrame, failure: DataFrame | None) -> DataFrame:
    def series(metrics: DataFrame, mode: str) -> DataFrame:
        return metrics.select(F.lit(mode).alias("mode"), "pipeline", "workload_id",
                              S.percent(F.col("dup_ratio")).alias("dup_pct"), "IPR")

    result = series(normal, "normal")
    if failure is not None:
        result = result.unionByName(series(failure, "failure"))
    return result.orderBy("mode", "pipeline", "dup_pct", "workload_id")


def comparison_table(metrics: DataFrame, failure: DataFrame | None = None) -> DataFrame:
    """Twelve columns per pipeline and category, one aggregate over all runs.

    Document counts use every run, storage only the valid ones. Rounding is half to even, in
    two steps where the second column is made from a rounded first.
    """
    valid = F.col("storage_valid")
    only = lambda name: F.when(valid, F.col(name))
    summary = metrics.groupBy(*GROUP).agg(
        F.count("*").alias("N_Runs"), F.count_if(valid).alias("N_Storage"),
        F.bround(F.bround(F.avg("M"), 4), 0).cast("long").alias("Avg_Docs"),
        F.bround(F.bround(F.avg(only("storage")), 4) / S.MB, 2).alias("Avg_Storage_MB"),
        F.bround(F.avg(only("SRR")), 4).alias("SRR_Mean"),
        F.bround(F.stddev_samp(only("SRR")), 4).alias("SRR_Std"),
        F.bround(F.avg("IPR"), 4).alias("IPR_Mean"), F.bround(F.avg("CE"), 4).alias("CE_Mean"))
    if failure is None:
        summary = summary.withColumn("IPR_Failure", F.lit(None).cast("double"))
    else:
        summary = join_back(summary, mean_ipr(failure, GROUP, "IPR_Failure"), GROUP, "left")
    return summary.withColumn("FLR_Mean", F.bround(1 - F.col("IPR_Failure"), 4)).select(
        *GROUP, "N_Runs", "N_Storage", "Avg_Docs", "Avg_Storage_MB", "SRR_Mean", "SRR_Std", "IPR_Mean",
        "IPR_Failure", "FLR_Mean", "CE_Mean")


def cumulative_growth(runs: DataFrame) -> DataFrame:
    return runs.select("pipeline", "workload_id", S.megabytes(F.col("total_storage")).alias("total_mb")).orderBy(
        "pipeline", "workload_id")


def cumulative_summary(runs: DataFrame, include_warmup: bool = False) -> DataFrame:
    """Final state per pipeline and its saving against the baseline's final state.

    Workload 0 is the warm-up of a cumulative series; it counts as a run only if asked to.
    """
    counted = F.lit(True) if include_warmup else F.col("workload_id") != 0
    finals = runs.groupBy("pipeline").agg(
        F.count_if(counted).alias("Workloads"),
        F.max_by("M", "workload_id").alias("Final_Docs"),
        F.max_by("total_storage", "workload_id").alias("_total"))
    base = finals.where(F.col("pipeline") == BASELINE).select(
        F.lit(1).alias("_one"), F.col("_total").alias("_base"))
    joined = finals.withColumn("_one", F.lit(1)).join(base, "_one", "left")
    reduction = F.when(F.col("_base") > 0, 1 - F.col("_total") / F.col("_base")).otherwise(F.lit(0.0))
    return joined.select(
        F.col("pipeline").alias("Pipeline"), "Workloads", "Final_Docs",
        F.bround(S.megabytes(F.col("_total")), 2).alias("Final_Storage_MB"),
        F.bround(reduction, 4).alias("Cumulative_SRR"))


def storage_by_workload(runs: DataFrame, ticks: int = 20, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Storage per workload with its band, its place on the axis and whether that place has a tick."""
    placed = rank_rows(
        runs.select("pipeline", "workload_id", "storage", "dup_ratio"), ["pipeline"], ["workload_id"],
        "position", hot_rows)
    sizes = runs.groupBy("pipeline").agg(F.count("*").alias("_runs"))
    step = F.greatest(F.lit(1), F.floor(F.col("_runs") / ticks))
    at = F.col("position") - 1
    return join_small(placed, sizes, ["pipeline"]).select(
        "pipeline", "workload_id", S.megabytes(F.col("storage")).alias("mb"),
        S.category(F.col("dup_ratio")).alias("category"), at.alias("position"),
        (F.pmod(at, step) == 0).alias("tick")).orderBy("pipeline", "position")


def storage_smoothed(runs: DataFrame, unit: float = S.MB, chunk_rows: int = CHUNK_ROWS,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Storage per workload with one-sided outliers replaced by the rolling median, then averaged.

    Median and deviation look two runs either way, the mean one; a smoothed value therefore
    depends on five neighbours, which is how far chunks overlap.
    """
    series = runs.select("pipeline", "workload_id", (F.col("storage") / F.lit(unit)).alias("mb"))
    spread = with_neighbours(series, ["pipeline"], ["workload_id"], 5, 5, chunk_rows, hot_rows)
    five, three = chunk_window(["pipeline"], -2, 2), chunk_window(["pipeline"], -1, 1)
    return (spread
            .withColumn("med", F.percentile("mb", 0.5).over(five))
            .withColumn("_off", F.abs(F.col("mb") - F.col("med")))
            .withColumn("mad", F.percentile("_off", 0.5).over(five))
            .withColumn("outlier", F.col("mb") > F.col("med") + 3 * (F.col("mad") + 1))
            .withColumn("_clean", F.when(F.col("outlier"), F.col("med")).otherwise(F.col("mb")))
            .withColumn("smoothed", F.avg("_clean").over(three))
            .where("_core").select("pipeline", "workload_id", "mb", "med", "mad", "outlier", "smoothed")
            .orderBy("pipeline", "workload_id"))


def category_regions(runs: DataFrame, chunk_rows: int = CHUNK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stretches of equal band in workload order, per pipeline.

    A region's k-th start belongs with the k-th end, so no running island number is needed.
    """
    series = runs.select("pipeline", "workload_id", S.category(F.col("dup_ratio")).alias("category"))
    window = chunk_window(["pipeline"])
    edges = (with_neighbours(series, ["pipeline"], ["workload_id"], 1, 1, chunk_rows, hot_rows)
             .withColumn("_first", ~F.lag("category").over(window).eqNullSafe(F.col("category"))
                         | F.lag("_pos").over(window).isNull())
             .withColumn("_last", ~F.lead("category").over(window).eqNullSafe(F.col("category"))
                         | F.lead("_pos").over(window).isNull())
             .where("_core").drop("_pos", "_chunk", "_core"))
    starts = rank_rows(edges.where("_first"), ["pipeline"], ["workload_id"], "region", hot_rows).select(
        "pipeline", "region", "category", F.col("workload_id").alias("start"))
    ends = rank_rows(edges.where("_last"), ["pipeline"], ["workload_id"], "region", hot_rows).select(
        "pipeline", "region", F.col("workload_id").alias("end"))
    return join_back(starts, ends, ["pipeline", "region"]).orderBy("pipeline", "region")

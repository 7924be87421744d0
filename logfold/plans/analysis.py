"""The analysis as one path: run tables on disk in, every report table out.

The tables are lazy; the metrics below them are written once, so that the reports do not read the files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logfold.plans import metrics, reports
from logfold.session import materialize
from logfold.sources.files import read_runs, write_csv


def analyze_runs(spark: SparkSession, runs_path: str, failure_path: str | None = None) -> dict[str, DataFrame]:
    """Metrics, exclusions and all report tables of a run table, and of one under failure if there is one.

    Without a failure table the columns about failure are NULL and its own tables are absent.
    """
    normal = materialize(metrics.run_metrics(read_runs(spark, runs_path)), "normal")
    failure = None if failure_path is None else materialize(metrics.run_metrics(read_runs(spark, failure_path)), "failure")
    tables = {
        "metrics": normal, "exclusions": reports.exclusion_report(normal), "exclusion_summary": reports.exclusion_summary(normal),
        "comparison": reports.comparison_table(normal, failure), "ipr_grid": reports.ipr_grid(normal, failure),
        "ipr_vs_dup": reports.ipr_vs_dup(normal, failure), "srr_by_dup": reports.srr_by_dup(normal), "storage_line": reports.storage_line(normal)}
    if failure is not None:
        tables |= {"failure_metrics": failure, "failure_impact": reports.failure_impact(normal, failure), "tradeoff": reports.tradeoff(normal, failure)}
    return tables


def analyze_cumulative(spark: SparkSession, runs_path: str, include_warmup: bool = False) -> dict[str, DataFrame]:
    """Growth and summary of runs that share one store."""
    runs = materialize(read_runs(spark, runs_path), "cumulative")
    return {"growth": reports.cumulative_growth(runs), "summary": reports.cumulative_summary(runs, include_warmup=include_warmup)}


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as CSV in a folder of its name."""
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}")

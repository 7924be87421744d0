"""From records to run tables: all strategies for all workloads in one grouped job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions import scalars as S
from logfold.functions.schedule import DEFAULT_EPS, emissions_until, last_emitted
from logfold.operators.ranking import HOT_ROWS, cut_points, join_back, join_small, running_sums
from logfold.session import materialize

PIPELINES = ("A", "B", "C")
# Bytes of an aggregated document beyond its payload and its two copies of the signature:
# an eight-byte count and a one-byte flag.
TAG_BYTES = 9


def record_bytes(*fields: str) -> Column:
    """Logical size of a record: the bytes of its text fields."""
    size = F.lit(0)
    for name in fields:
        size = size + F.coalesce(F.octet_length(name), F.lit(0))
    return size.cast("long")


def duplication(df: DataFrame, by: Sequence[str] = (), sig: str = "sig", approximate: bool = False) -> DataFrame:
    """Lines N, distinct signatures U, duplicate ratio and compression, per group or overall.

    Exact counts take a second small aggregate; ``approximate`` uses a sketch and one pass.
    """
    if approximate:
        counts = df.groupBy(*by).agg(F.count("*").alias("N"), F.approx_count_distinct(sig).alias("U"))
    else:
        per_sig = df.groupBy(*by, sig).agg(F.count("*").alias("_n"))
        counts = per_sig.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("N"), F.count("*").alias("U"))
    return counts.select(*by, "N", "U", (1 - S.ratio_or_zero(F.col("U"), F.col("N"))).alias("dup_ratio"),
                         S.ratio_or_zero(F.col("N"), F.col("U")).alias("CE"))


def fold_workloads(df: DataFrame, workload: str = "workload_id", eps: float = DEFAULT_EPS, sig: str = "sig",
                   size: str = "bytes", epoch: Column | None = None) -> DataFrame:
    """One row per workload with all that the strategies' runs are made of.

    Two hash aggregates: per (workload, signature), combined before the shuffle, then per
    workload. A folded document is as large as the largest record of its signature plus the
    tags. ``epoch`` (0 or 1) marks the records after a counter restart: counters start again
    and the later epoch's count overwrites the stored one.
    """
    later = epoch.cast("long") if epoch is not None else F.lit(0).cast("long")
    per_sig = df.groupBy(F.col(workload).alias("workload_id"), sig).agg(
        F.count("*").alias("n"), F.sum(later).alias("n1"),
        F.sum(size).alias("all_bytes"), F.max(size).alias("doc_bytes"))
    kept = "if(n1 > 0, n1, n)"
    totals = [
        F.sum("n").alias("N"), F.count("*").alias("U"), F.sum("all_bytes").alias("raw_bytes"),
        F.sum(F.col("doc_bytes") + 2 * F.octet_length(sig) + TAG_BYTES).alias("folded_bytes"),
        F.sum(last_emitted("n", eps)).alias("bounded"), F.sum(emissions_until("n", eps)).alias("sent")]
    if epoch is not None:
        totals += [
            F.sum(F.expr(kept)).alias("kept"), F.sum(last_emitted(kept, eps)).alias("kept_bounded"),
            F.sum(emissions_until("n - n1", eps) + emissions_until("n1", eps)).alias("kept_sent")]
    return per_sig.groupBy("workload_id").agg(*totals)


def runs_table(folded: DataFrame, restarted: bool = False) -> DataFrame:
    """Three runs per workload, one for each strategy, in the columns of a run table."""
    exact, bounded, sent = ("kept", "kept_bounded", "kept_sent") if restarted else ("N", "bounded", "sent")
    folded = folded.withColumn("_run", F.expr(f"""explode(array(
        named_struct('p', 'A', 'm', N, 'size', raw_bytes, 'kept', N, 'sent', N),
        named_struct('p', 'B', 'm', U, 'size', folded_bytes, 'kept', {bounded}, 'sent', {sent}),
        named_struct('p', 'C', 'm', U, 'size', folded_bytes, 'kept', {exact}, 'sent', N)))"""))
    return folded.selectExpr(
        "_run.p AS pipeline", "workload_id", "1 - U / N AS dup_ratio", "cast(NULL AS bigint) AS seed", "N",
        "_run.m AS M", "_run.size AS storage", "_run.size AS total_storage", "_run.kept AS reconstructed",
        "_run.sent AS forwarded", f"'{'restart' if restarted else 'false'}' AS failed", "true AS settled",
        "cast(NULL AS string) AS timestamp")


def evaluate_strategies(df: DataFrame, workload: str = "workload_id", eps: float = DEFAULT_EPS,
                        sig: str = "sig", size: str = "bytes") -> DataFrame:
    """The run table: what each strategy stores, sends and preserves per workload."""
    return runs_table(fold_workloads(df, workload, eps, sig, size))


def fold_restarted(df: DataFrame, order: Sequence[str], cut: float = 0.5, workload: str = "workload_id",
                   eps: float = DEFAULT_EPS, sig: str = "sig", size: str = "bytes",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """``fold_workloads`` with the counters restarted after the share ``cut`` of each workload.

    Serves the run tables with and without the restart from one pass over the log. The first
    order column must be numeric. The cut is the exact record; it is found without ordering
    the workload, so only the order columns of one slot are ever sorted.
    """
    cuts = cut_points(df, [workload], order, cut, hot_rows=hot_rows).drop("rows")
    placed = join_small(df.select(workload, sig, size, *order), cuts, [workload])
    after = F.struct(*order) > F.struct(*[F.col(f"cut_{c}").alias(c) for c in order])
    return fold_workloads(placed, workload, eps, sig, size, F.when(~F.col("has_cut") | after, 1).otherwise(0))


def cumulative_runs(df: DataFrame, workload: str = "workload_id", sig: str = "sig",
                    size: str = "bytes", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Growth of one shared store over the workloads in order, nothing cleared in between.

    A document counts for the workload that first shows its signature, with its size there.
    """
    per_sig = materialize(df.groupBy(workload, sig).agg(
        F.count("*").alias("n"), F.sum(size).alias("all_bytes"), F.max(size).alias("doc_bytes")), "per_sig")
    appended = per_sig.groupBy(workload).agg(
        F.sum("n").alias("N"), F.sum("n").alias("docs"), F.sum("all_bytes").alias("added"))
    first = per_sig.groupBy(sig).agg(
        F.min(workload).alias(workload), F.min_by("doc_bytes", workload).alias("doc_bytes"))
    folded = first.groupBy(workload).agg(
        F.count("*").alias("docs"),
        F.sum(F.col("doc_bytes") + 2 * F.octet_length(sig) + TAG_BYTES).alias("added"))
    folded = join_back(appended.select(workload, "N"), folded, [workload], "left").na.fill(0, ["docs", "added"])
    steps = appended.withColumn("pipeline", F.lit("A"))
    for name in ("B", "C"):
        steps = steps.unionByName(folded.withColumn("pipeline", F.lit(name)))
    steps = materialize(steps.withColumnRenamed(workload, "workload_id"), "steps")
    grown = running_sums(steps, ["pipeline"], ["workload_id"],
                         {"M": "docs", "total_storage": "added"}, hot_rows=hot_rows)
    return grown.select("pipeline", "workload_id", "N", "M", "total_storage")


def experiment_matrix(workloads: DataFrame, modes: Sequence[str] = ("clean_slate",)) -> DataFrame:
    """Every mode and pipeline for every workload; the two short lists are literals."""
    return workloads.select("workload_id", F.explode(F.array(*map(F.lit, modes))).alias("mode")).select(
        "mode", F.explode(F.array(*map(F.lit, PIPELINES))).alias("pipeline"), "workload_id")


def missing_runs(matrix: DataFrame, runs: DataFrame) -> DataFrame:
    """Expected runs without a result row.

    A run counts for its own mode; runs without a ``mode`` column count for every mode.
    """
    keys = ["mode", "pipeline", "workload_id"] if "mode" in runs.columns else ["pipeline", "workload_id"]
    return matrix.join(runs, keys, "left_anti")

"""Answers drawn from the metrics: which strategy, what a stream promises, when it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.functions import scalars as S
from logfold.functions.schedule import DEFAULT_EPS, last_emitted
from logfold.operators.amplify import distinct_target
from logfold.operators.ranking import CHUNK_ROWS, HOT_ROWS, chunk_window, join_back, with_neighbours
from logfold.plans.reports import with_failure

# Fixed values of the completion rule.
DONE_PERCENT = 99
WARMUP_POLLS = 3
STABLE_POLLS = 10


def restart_loss(normal: DataFrame, failure: DataFrame) -> DataFrame:
    """Per run what a counter restart costs."""
    other = failure.select("pipeline", "workload_id", F.col("reconstructed").alias("reconstructed_failure"))
    joined = join_back(with_failure(normal, failure), other, ["pipeline", "workload_id"], "left")
    return joined.select("pipeline", "workload_id", "N", "reconstructed", "reconstructed_failure",
                         F.col("IPR").alias("IPR_normal"), "IPR_failure", "FLR", "loss_failure")


def recommend(normal: DataFrame, failure: DataFrame, max_loss: float, max_crash_loss: float) -> DataFrame:
    """Per workload the strategy that saves most within both loss bounds.

    ``normal`` carries the ``forwarded`` column; ties go to fewer forwarded records, then to
    the first name. Workloads where nothing qualifies, or whose crash loss is unknown, keep NULLs.
    """
    runs = with_failure(normal, failure)
    fits = (F.col("SRR").isNotNull() & (1 - F.col("IPR") <= max_loss)
            & F.coalesce(F.col("FLR") <= max_crash_loss, F.lit(False)))
    rank = F.when(fits, F.struct((-F.col("SRR")).alias("a"), F.col("forwarded").alias("b"),
                                 F.col("pipeline").alias("c")))
    pick = F.struct("pipeline", "SRR", "IPR", "FLR", "forwarded")
    return runs.groupBy("workload_id").agg(
        F.max("dup_ratio").alias("dup_ratio"), F.min_by(pick, rank).alias("_best")).select(
        "workload_id", "dup_ratio", "_best.*")


def validate_contract(df: DataFrame, total: int, dup_ratio: float, eps: float = DEFAULT_EPS,
                      sig: str = "sig") -> DataFrame:
    """One row: does the stream hold what its duplicate ratio promises?

    Preserved shares are taken against ``total``, so lines that got lost show in them.
    """
    counts = df.groupBy(sig).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("U"),
        F.coalesce(F.sum(last_emitted("n", eps)), F.lit(0)).alias("bounded"))
    wanted = distinct_target(total, dup_ratio)
    tolerance = 1e-9
    expected_ce = total / wanted
    return counts.select(
        "N", "U", F.lit(wanted).cast("long").alias("expected_U"),
        S.ratio_or_zero(F.col("N"), F.col("U")).alias("CE"), F.lit(expected_ce).alias("expected_CE"),
        S.preserved(F.col("bounded"), F.lit(total)).alias("IPR_B"),
        S.preserved(F.col("N"), F.lit(total)).alias("IPR_C"), (F.col("N") == total).alias("lines_ok"),
        (F.col("U") == wanted).alias("distinct_ok"),
        (F.abs(S.ratio_or_zero(F.col("N"), F.col("U")) - expected_ce) < tolerance).alias("ce_ok"),
        (F.col("bounded") / F.lit(total) >= 1 / (1 + eps) - tolerance).alias("bound_ok"))


def ingest_completeness(progress: DataFrame, target: str = "target", chunk_rows: int = CHUNK_ROWS,
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """When each run's ingest was complete, from polls ``(run, poll, docs, ops, target)``.

    Complete at the first poll whose operations reach 99 % of the target, else after ten polls
    in a row, past the warm-up, at which the document count stood still above zero. A store
    shared by several runs counts on; an optional ``start_ops`` column is taken off.
    """
    start = F.col("start_ops") if "start_ops" in progress.columns else F.lit(0)
    polls = progress.withColumn("_ops", F.col("ops") - start)
    spread = with_neighbours(polls, ["run"], ["poll"], STABLE_POLLS, 0, chunk_rows, hot_rows)
    previous = F.lag("docs").over(chunk_window(["run"]))
    flat = ((F.col("_pos") > WARMUP_POLLS) & (F.col("docs") > 0) & (F.col("docs") == previous))
    span = chunk_window(["run"], 1 - STABLE_POLLS, 0)
    judged = (spread.withColumn("_flat", F.coalesce(flat, F.lit(False)).cast("int"))
              .withColumn("_stable", F.sum("_flat").over(span)).where("_core"))
    first = lambda condition: F.min(F.when(condition, F.col("poll")))
    found = judged.groupBy("run").agg(
        F.max(target).alias("target"), F.max("_ops").alias("ops"),
        first(F.col("_ops") >= F.floor(F.col(target) / 2)).alias("half_poll"),
        first(F.col("_ops") >= F.floor(F.col(target) * DONE_PERCENT / 100)).alias("done_poll"),
        first(F.col("_stable") >= STABLE_POLLS).alias("plateau_poll"))
    done, plateau = F.col("done_poll"), F.col("plateau_poll")
    return found.select(
        "*", F.least(done, plateau).alias("complete_poll"),
        F.when(done.isNotNull() & (plateau.isNull() | (done <= plateau)), "target")
        .when(plateau.isNotNull(), "plateau").otherwise("open").alias("reason"))

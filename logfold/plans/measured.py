"""Run rows measured from what the strategies store, instead of computed from the log.

``store_strategies`` writes the table of each strategy, one folder per workload; ``measure_runs`` reads files and stored
counts and makes a run table of them. Sizes are bytes of files, documents are stored keys, the reconstructed volume is
the sum of stored counts, and a workload is settled if nothing in it is superseded and it has no more files than
its size needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions.masking import tag_record
from logfold.functions.schedule import DEFAULT_EPS, emissions_until
from logfold.operators.folding import edge_emissions
from logfold.operators.ranking import HOT_ROWS, join_back
from logfold.operators.tables import TARGET_BYTES
from logfold.session import materialize

WORKLOAD = "workload_id"


def _write(df: DataFrame, path: str) -> None:
    """One folder per workload; a workload's rows stay together unless they are more than a partition should hold."""
    df.hint("rebalance", WORKLOAD).write.mode("append").partitionBy(WORKLOAD).parquet(path)


def _last_per_key(df: DataFrame, order: Sequence[str], sig: str) -> DataFrame:
    """The last row of each signature of each workload, and how many there were."""
    payload = F.struct(*[c for c in df.columns if c not in (WORKLOAD, sig)])
    folded = df.groupBy(F.xxhash64(WORKLOAD, sig).alias("_hash"), WORKLOAD, sig).agg(
        F.max_by(payload, F.struct(*order)).alias("_row"), F.count("*").alias("_n"))
    return folded.select(WORKLOAD, sig, "_row.*", "_n")


def store_strategies(df: DataFrame, root: str, order: Sequence[str], eps: float = DEFAULT_EPS, sig: str = "sig", hot_rows: int = HOT_ROWS) -> None:
    """Write the documents of strategies A, B and C under ``root``; df has workload_id, the signature and the payload.

    A keeps every record, C the last record of a signature with its exact count, B the record it emitted last, with the
    count it had then.
    """
    _write(df, f"{root}/A")
    last = _last_per_key(df, order, sig)
    _write(tag_record(last, sig, F.col("_n")).drop("_n"), f"{root}/C")
    # a signature of one workload is counted apart from the same one of another
    apart = df.withColumn("_key", F.struct(WORKLOAD, sig))
    emitted = edge_emissions(materialize(apart, "apart"), order, eps, "_key", hot_rows).drop("_key", "_agg_id", "_agg_signature", "aggregated")
    stored = _last_per_key(emitted, ["count"], sig).drop("_n")
    _write(tag_record(stored, sig, F.col("count")), f"{root}/B")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"))


def _files(rows: DataFrame) -> DataFrame:
    """Files, bytes and rows of each workload, from the scan's own figures of its files."""
    each = rows.groupBy(WORKLOAD, "_file").agg(F.max("_size").alias("size"), F.count("*").alias("rows"))
    return each.groupBy(WORKLOAD).agg(F.count("*").alias("files"), F.sum("size").alias("storage"), F.sum("rows").alias("rows"))


def measure_runs(spark: SparkSession, root: str, eps: float = DEFAULT_EPS, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The run table of what ``store_strategies`` wrote, or what became of it since."""
    everything = _files(_stored(spark, f"{root}/A")).select(
        F.lit("A").alias("pipeline"), WORKLOAD, "files", "storage", F.col("rows").alias("M"), F.lit(0).cast("long").alias("superseded"),
        F.col("rows").alias("reconstructed"), F.col("rows").alias("forwarded"))
    parts = [everything]
    for name in ("B", "C"):
        rows = _stored(spark, f"{root}/{name}")
        keys = rows.groupBy(WORKLOAD, "_agg_id").agg(F.max("count").alias("count"), F.count("*").alias("n"))
        docs = keys.groupBy(WORKLOAD).agg(
            F.count("*").alias("M"), F.sum(F.col("n") - 1).alias("superseded"), F.sum("count").alias("reconstructed"),
            F.sum(emissions_until("count", eps) if name == "B" else F.col("count")).alias("forwarded"))
        parts.append(join_back(_files(rows).drop("rows"), docs, [WORKLOAD]).select(F.lit(name).alias("pipeline"), *everything.columns[1:]))
    runs = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "measured")
    totals = runs.groupBy(WORKLOAD).agg(
        F.max(F.when(F.col("pipeline") == "A", F.col("M"))).alias("N"), F.max(F.when(F.col("pipeline") == "C", F.col("M"))).alias("U"))
    settled = (F.col("superseded") == 0) & (F.col("files") <= F.greatest(F.lit(1), F.ceil(F.col("storage") / target_bytes)))
    return join_back(runs, totals, [WORKLOAD]).select(
        "pipeline", WORKLOAD, (1 - F.col("U") / F.col("N")).alias("dup_ratio"), F.lit(None).cast("long").alias("seed"), "N", "M", "storage",
        F.col("storage").alias("total_storage"), "reconstructed", "forwarded", F.lit("false").alias("failed"), settled.alias("settled"),
        F.lit(None).cast("string").alias("timestamp"))

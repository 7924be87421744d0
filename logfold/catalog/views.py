"""Log tables made from the driver's tables.

Each view has level, component, message, an order that is total, a workload and the record's
size. ``sig`` is the only costly column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions.masking import with_signature
from logfold.functions.scalars import letters, micros
from logfold.operators.ranking import join_small, running_sums
from logfold.plans.runs import record_bytes
from logfold.session import materialize

EVENT_ORDER = ("ts_us", "event_id")
LINE_ORDER = ("doc_id", "pos")
ITEM_ORDER = ("l_orderkey", "l_linenumber")
SIZED = ("level", "component", "message")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that comes in fewer splits than there are cores.

    Larger tables have more splits and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def event_log(spark: SparkSession, sf: str, entity: str) -> DataFrame:
    """The events as log records about a lettered entity; one workload per day."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id", micros("ts").alias("ts_us"), day.alias("workload_id"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"), kind.alias("component"),
        F.concat(F.lit("user "), letters(entity), F.lit(" "), kind, F.lit(" "), F.col("props")).alias("message"))
    return with_signature(rows.withColumn("bytes", record_bytes(*SIZED)))


def by_user(spark: SparkSession, sf: str, users: int) -> DataFrame:
    """Few entities, so every signature is hot."""
    return event_log(spark, sf, f"user_id % {users}")


def daily_log(spark: SparkSession, sf: str) -> DataFrame:
    """More entities the later in the month, so the days differ in duplication."""
    return event_log(spark, sf, "user_id % (5 * dayofmonth(ts))")


def line_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document."""
    lines = spread(table(spark, sf, "documents")).select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "message"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), "source",
                        F.upper("lang").alias("level"), F.col("source").alias("component"), "message")


def item_log(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as log records: a handful of signatures, all of them hot."""
    return with_signature(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("level"),
        F.col("l_returnflag").alias("component"),
        F.concat(F.lit("order "), F.col("l_orderkey"), F.lit(" part "), F.col("l_partkey"), F.lit(" line "),
                 F.col("l_linenumber")).alias("message")))


def chat_log(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns; one workload per conversation."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("workload_id"), "turn", F.col("role").alias("level"),
        F.lit("chat").alias("component"), F.col("text").alias("message"))
    return with_signature(rows.withColumn("bytes", record_bytes(*SIZED)))


def ingest_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly polls of each event type's ingest.

    Operations count its events so far. Documents count those too for two types that keep every
    record, and the users seen so far for the others. One type's target is twice its volume.
    """
    hour = F.floor(F.col("ts_us") / 3600000000)
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("run"), "user_id", micros("ts").alias("ts_us"))
    events = events.select("run", "user_id", hour.alias("hour"))
    arrived = events.groupBy("run", "hour").agg(F.count("*").alias("new_ops"))
    seen = events.groupBy("run", "user_id").agg(F.min("hour").alias("hour")).groupBy("run", "hour").agg(
        F.count("*").alias("new_docs"))
    polls = materialize(arrived.join(seen, ["run", "hour"], "left").na.fill(0, ["new_docs"]), "polls")
    totals = polls.groupBy("run").agg(F.sum("new_ops").alias("total"))
    polls = polls.withColumn("new_docs", F.when(
        F.col("run").isin("click", "signup"), F.col("new_ops")).otherwise(F.col("new_docs")))
    grown = running_sums(polls, ["run"], ["hour"], {"ops": "new_ops", "docs": "new_docs"})
    late = F.col("run") == "view"
    return join_small(grown, totals, ["run"]).select(
        "run", F.col("hour").alias("poll"), "docs", "ops",
        F.when(late, F.col("total") * 2).otherwise(F.col("total")).alias("target"))

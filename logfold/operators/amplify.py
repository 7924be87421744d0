"""Turn distinct records into a stream with a chosen share of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions.scalars import plus_micros, power_index, unit_hash
from logfold.operators.ranking import HOT_ROWS, rank_rows

SALT_ROWS = 1_000_000


def distinct_target(total: int, dup_ratio: float) -> int:
    """How many distinct records a stream of ``total`` has at this duplicate ratio."""
    return min(total, max(1, round(total * (1 - dup_ratio))))


def _salts(index: Column, distinct: int, repeats: int, skew: float, salt_rows: int) -> Column:
    """Into how many parts the repeats of one index are split, from their expected number."""
    share = (F.pow((index + 1) / F.lit(distinct), F.lit(1 / skew))
             - F.pow(index / F.lit(distinct), F.lit(1 / skew)))
    return F.greatest(F.lit(1), F.ceil(share * repeats / F.lit(salt_rows))).cast("long")


def amplify_duplicates(df: DataFrame, order: Sequence[str], total: int, dup_ratio: float, skew: float = 2.0,
                       seed: str = "42", start: str = "2025-01-01 00:00:00", hot_rows: int = HOT_ROWS,
                       salt_rows: int = SALT_ROWS) -> DataFrame:
    """``total`` records of which ``distinct_target`` are distinct, shuffled and time-stamped.

    The first distinct records by ``order`` each appear once; the rest are repeats drawn with
    a power law. Position in the stream follows an MD5 order, timestamps step by 1 us. Slots
    are generated and ordered as narrow rows; the payload joins at the end, with the parts
    of hot indices spread over copies of their one base row. A base with fewer rows than the
    stream needs distinct records is an error.
    """
    spark = df.sparkSession
    distinct = distinct_target(total, dup_ratio)
    repeats = total - distinct
    rows = df.count()
    if rows < distinct:
        raise ValueError(f"{total} records at ratio {dup_ratio} need {distinct} distinct ones; the base has {rows}")
    slot = F.col("id")
    drawn = power_index(unit_hash(seed, slot), distinct, skew)
    slots = spark.range(total).select(
        slot.alias("slot"), F.when(slot < distinct, slot).otherwise(drawn).alias("index"),
        F.md5(F.concat_ws("-", F.lit(seed), F.lit("order"), slot.cast("string"))).alias("_mix"))
    placed = rank_rows(slots, [], ["_mix", "slot"], "_pos", hot_rows).drop("_mix")
    placed = placed.withColumn("_salt", F.pmod(
        F.xxhash64("slot"), _salts(F.col("index"), distinct, repeats, skew, salt_rows)))

    base = (rank_rows(df, [], order, "index", hot_rows).withColumn("index", F.col("index") - 1)
            .where(F.col("index") < distinct))
    base = base.withColumn("_salt", F.explode(F.sequence(
        F.lit(0).cast("long"), _salts(F.col("index"), distinct, repeats, skew, salt_rows) - 1)))
    return (placed.join(base, ["index", "_salt"]).drop("_salt")
            .withColumn("position", F.col("_pos") - 1)
            .withColumn("timestamp", plus_micros(start, F.col("position"))).drop("_pos"))

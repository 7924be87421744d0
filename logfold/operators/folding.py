"""The three collapse strategies over records that carry a signature column.

A keeps every record. B emits a signature's first record and then only at the counts of the
emission schedule. C emits every record with its running count. The store behind B and C is
keyed by signature, last write wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.functions.masking import tag_record
from logfold.functions.schedule import DEFAULT_EPS, emission_table, emissions_until, last_emitted
from logfold.operators.ranking import HOT_ROWS, pick_rows, rank_rows


def keep_all(df: DataFrame) -> DataFrame:
    """Strategy A: every record is a document."""
    return df


def running_counts(df: DataFrame, order: Sequence[str], sig: str = "sig",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Strategy C, record by record: record k of its signature carries count k."""
    return tag_record(rank_rows(df, [sig], order, "count", hot_rows), sig, F.col("count"))


def edge_emissions(df: DataFrame, order: Sequence[str], eps: float = DEFAULT_EPS, sig: str = "sig",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Strategy B, record by record: only the records whose count is on the schedule."""
    counted = running_counts(df, order, sig, hot_rows)
    if eps <= 0:
        return counted
    schedule = F.broadcast(emission_table(df.sparkSession, eps))
    return counted.join(schedule, counted["count"] == schedule["e"], "left_semi")


def first_sightings(df: DataFrame, order: Sequence[str], sig: str = "sig") -> DataFrame:
    """The first record of every signature; partial aggregation, no window."""
    return pick_rows(df, sig, order, last=False)


def last_records(df: DataFrame, order: Sequence[str], sig: str = "sig") -> DataFrame:
    """The last record of every signature."""
    return pick_rows(df, sig, order)


def distinct_documents(df: DataFrame, sig: str = "sig") -> DataFrame:
    """One arbitrary record per signature."""
    return df.dropDuplicates([sig])


def signature_counts(df: DataFrame, sig: str = "sig") -> DataFrame:
    """Exact records per signature: the counts strategy C ends up with."""
    return df.groupBy(sig).agg(F.count("*").alias("count"))


def index_documents(df: DataFrame, order: Sequence[str], sig: str = "sig") -> DataFrame:
    """Strategy C's final table: last record of each signature with the exact count."""
    folded = pick_rows(df, sig, order, count="_n")
    return tag_record(folded, sig, F.col("_n")).drop("_n")


def edge_counts(df: DataFrame, eps: float = DEFAULT_EPS, sig: str = "sig") -> DataFrame:
    """Strategy B's final counts, without numbering a single record.

    ``n`` records were seen, ``stored`` is the largest schedule value up to it and
    ``forwarded`` how many emissions led there.
    """
    counts = df.groupBy(sig).agg(F.count("*").alias("n"))
    return counts.select(sig, "n", last_emitted("n", eps).alias("stored"),
                         emissions_until("n", eps).alias("forwarded"))


def hot_signatures(df: DataFrame, k: int = 20, sig: str = "sig") -> DataFrame:
    """The k most frequent signatures, ties by signature."""
    return signature_counts(df, sig).orderBy(F.desc("count"), F.asc(sig)).limit(k)

"""Small column expressions used by the metric and report plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the duplication bands.
LOW_MAX, MED_MAX = 0.30, 0.70
MB = 1024 * 1024


def category(ratio: Column) -> Column:
    """Duplication band of a ratio; NULL stays NULL."""
    return F.when(ratio <= LOW_MAX, "low").when(ratio <= MED_MAX, "med").when(ratio.isNotNull(), "high")


def megabytes(size: Column) -> Column:
    return size / F.lit(MB)


def percent(ratio: Column) -> Column:
    return ratio * 100


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def preserved(reconstructed: Column, total: Column) -> Column:
    """Information preservation, at most 1; 0 for an empty input."""
    return F.when(total > 0, F.least(F.lit(1.0), reconstructed / total)).otherwise(F.lit(0.0))


def bytes_per_doc(storage: Column, docs: Column) -> Column:
    return F.when(docs > 0, storage / docs)


def storage_reduction(storage: Column, base: Column, valid: Column) -> Column:
    """1 - storage/base where both are trustworthy, else NULL so that means skip it."""
    return F.when(valid & (base > 0), 1 - storage / base)


def is_settled(flag: Column) -> Column:
    """Anything but a written ``false`` counts as settled, a missing flag too."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))) != "false", F.lit(True))


def count_or_zero(text: Column) -> Column:
    """Digits only, as text, to a count; anything else (signs, blanks, words, NULL) is 0."""
    return F.when(text.rlike("^[0-9]+$"), F.coalesce(text.try_cast("long"), F.lit(0))).otherwise(F.lit(0))


def reconstructed_or_docs(reconstructed: Column, docs: Column) -> Column:
    """Drop the fraction; an absent or zero total means one record per document."""
    whole = F.floor(F.coalesce(reconstructed.cast("double"), F.lit(0.0))).cast("long")
    return F.when(whole == 0, docs).otherwise(whole)


def json_number(doc: Column, path: str) -> Column:
    """A number inside a JSON document, 0 where the path is absent."""
    return F.coalesce(F.get_json_object(doc, path).try_cast("double"), F.lit(0.0))


def letters(index: str) -> Column:
    """Bijective base-26 token of an integer column or expression: 0 is a, 25 is z, 26 is aa.

    Digit p from the right exists once the index reaches the number of tokens that are
    at most p letters long. Fourteen letters cover a long.
    """
    parts, shorter = [], 0
    for p in range(14):
        parts.append(f"if(({index}) >= {shorter}, "
                     f"chr(97 + pmod(cast(({index}) - {shorter} AS bigint) div {26 ** p}, 26)), '')")
        shorter += 26 ** (p + 1)
        if shorter >= 2 ** 63:
            break
    return F.expr(f"concat({', '.join(reversed(parts))})")


def unit_hash(seed: str, *parts: Column) -> Column:
    """A repeatable uniform number in [0, 1) from the first 32 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("-", F.lit(seed), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def power_index(uniform: Column, size: Column | int, skew: float) -> Column:
    """An index in [0, size) that favours small values the more the larger ``skew`` is."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.least(size - 1, F.floor(size * F.pow(uniform, F.lit(float(skew))))).cast("long")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp column, whatever the session's zone.

    Seconds come without a zone. The fraction of a second is the same in every zone, so the
    zoned cast may supply it. Seconds before 1970 are cut towards zero and need one less.
    """
    fraction = f"pmod(unix_micros(cast({ts} AS timestamp)), 1000000)"
    early = f"if({ts} < timestamp_ntz'1970-01-01 00:00:00' AND {fraction} > 0, 1, 0)"
    return F.expr(f"(unix_timestamp({ts}) - {early}) * 1000000 + {fraction}")


def plus_micros(start: str, offset: Column) -> Column:
    """Zone-free timestamp ``offset`` microseconds after ``start``."""
    seconds = (offset.cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)

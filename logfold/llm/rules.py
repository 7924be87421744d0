"""Quality rules with adaptive thresholds.

Every document gets integer measures. Mergeable quantile sketches of the measures (counts per bucket, buckets
with a relative width of 1/32, merged by adding counts) are kept per language and source, per language, and over
all; each level gives fences around its middle half. Most documents have no repeated line or word, so for these two
measures (``SOME``) the middle half is that of the documents which have some. A document is joined, for each measure,
with the fence of its source if ``MIN_GROUP`` documents made that, else of its language, else of the whole, and is
rejected outside of any fence.

Null text: no words, so the base rule fails. Null language or source: a group of its own. Rows are judged one by
one, so repeated rows and repeated ids each get their own verdict. An empty table gives an empty result. Columns
of the input other than those named are ignored by ``measure`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from logfold.llm.texts import slices, text_of, words_of
from logfold.session import materialize

#: Documents that a source or language must have for fences of its own.
MIN_GROUP = 200
#: Width of the fences in widths of the middle half.
SPREAD = 4
#: measure: (slack added to the upper fence, slack of the lower fence or None for no lower fence).
MEASURES = {
    "letters_per_word": (200, 200),
    "symbols_per_mille": (20, None),
    "upper_per_mille": (150, None),
    "dup_lines_per_mille": (50, None),
    "repeats_per_mille": (200, None),
}
#: Measures whose sketch leaves out 0.
SOME = ("dup_lines_per_mille", "repeats_per_mille")
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the seven counts to the columns before the text, which is the last column."""
    for batch in slices(batches, "_text"):
        texts = pc.fill_null(batch.column("_text"), "")
        codes, _, offsets = words_of(texts)
        n_words = np.diff(offsets)
        word_chars = pc.utf8_length(texts).to_numpy() - pc.count_substring_regex(texts, r"[\x20\x09-\x0D]").to_numpy()
        codes = codes.astype(np.int64)
        repeats, dup_lines, lines = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        size = int(codes.max()) + 1 if len(codes) else 1
        for row in range(batch.num_rows):
            begin, end = offsets[row], offsets[row + 1]
            if end - begin >= 4:
                own = codes[begin:end]
                if size >= 1 << 21:  # three codes of 21 bits fit into 63
                    own = np.unique(own, return_inverse=True)[1]
                _, which, times = np.unique((own[:-2] << 42) | (own[1:-1] << 21) | own[2:], return_inverse=True, return_counts=True)
                again = times[which] > 1
                if again.any():
                    covered = np.zeros(end - begin, bool)
                    for shift in range(3):
                        covered[shift:shift + len(again)] |= again
                    repeats[row] = covered.sum()
        for row, text in enumerate(texts.to_pylist()):
            full = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            lines[row], dup_lines[row] = len(full), len(full) - len(set(full))
        counts = (n_words, word_chars, pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(), dup_lines, repeats, lines,
                  pc.count_substring_regex(texts, "[A-Z]").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(x.astype(np.int64)) for x in counts)],
            names=[*batch.schema.names[:-1], *(x.split()[0] for x in COUNTS.split(", "))])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, _lang, _source and the counts; one row per document."""
    slim = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), text_of().alias("_text"))
    return slim.mapInArrow(_count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _lang string, _source string, {COUNTS}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Whole numbers, so that buckets never depend on rounding."""
    over = lambda a, scale, b: F.floor(F.col(a) * scale / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"letters_per_word": over("word_chars", 100, "n_words"), "symbols_per_mille": over("n_symbols", 1000, "n_words"),
            "upper_per_mille": over("n_upper", 1000, "word_chars"), "dup_lines_per_mille": over("n_dup_lines", 1000, "n_lines"),
            "repeats_per_mille": over("n_repeat_words", 1000, "n_words")}


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket: exact below 64, else its six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """_level, _lang, _source, name, at, n: counts per bucket on three levels, of documents that pass the base rule.

    A sketch has at most a few hundred rows however many documents it covers, and sketches of parts of the
    corpus merge by adding n.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), bucket(v).alias("at")) for k, v in measures().items())))
    fine = (measured.filter(~base_failed()).select("_lang", "_source", pairs.alias("p"))
            .filter(~F.col("p.name").isin(*SOME) | (F.col("p.at") > 0)).groupBy("_lang", "_source", "p.name", "p.at").agg(F.count(F.lit(1)).alias("n")))
    levels = F.explode(F.array(F.struct(F.lit(0).alias("l"), "_lang", "_source"),
                               F.struct(F.lit(1).alias("l"), F.col("_lang"), F.lit("").alias("_source")),
                               F.struct(F.lit(2).alias("l"), F.lit("").alias("_lang"), F.lit("").alias("_source"))))
    return (fine.select(levels.alias("k"), "name", "at", "n")
            .groupBy(F.col("k.l").alias("_level"), "k._lang", "k._source", "name", "at").agg(F.sum("n").alias("n")))


def fences(sketch: DataFrame) -> DataFrame:
    """_level, _lang, _source and per measure two fences and the number of documents that made them."""
    group = ["_level", "_lang", "_source", "name"]
    running = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("at"))).withColumn(
        "docs", F.sum("n").over(Window.partitionBy(*group)))
    cuts = [F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("at"))).alias(f"q{q}") for q in (1, 3)]
    middle = running.groupBy(*group).agg(F.max("docs").alias("docs"), *cuts)
    slack = lambda i: F.create_map(*(F.lit(x) for k, v in MEASURES.items() for x in (k, v[i])))[F.col("name")]
    wide = SPREAD * (F.col("q3") - F.col("q1"))
    ends = middle.withColumn("low", F.col("q1") - wide - slack(1)).withColumn("high", F.col("q3") + wide + slack(0))
    return ends.groupBy("_level", "_lang", "_source").agg(
        *(F.max(F.when(F.col("name") == k, F.col(end))).alias(f"{end}_{k}") for k in MEASURES for end in ("docs", "low", "high")))


def judge(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add base_failed, kept and the widest level whose fences were used.

    ``bounds`` is written first, so Spark knows its size: it is broadcast below the session's limit and otherwise
    joined by a shuffle in which adaptive execution splits hot sources.
    """
    names = [f"{end}_{k}" for k in MEASURES for end in ("docs", "low", "high")]
    ends = F.struct(*names)
    out = measured
    for level, on in ((0, ["_lang", "_source"]), (1, ["_lang"]), (2, [])):
        own = bounds.filter(F.col("_level") == level)
        if on:
            side = own.select(*on, ends.alias(f"_b{level}"))
            out = out.join(side, on, "left")
    whole = bounds.filter(F.col("_level") == 2).select(ends.alias("b")).head()
    if whole:
        top = F.struct(*(F.lit(whole.b[k]).cast("long").alias(k) for k in names))
    else:
        top = F.lit(None).cast(f"struct<{','.join(f'{x}:bigint' for x in names)}>")
    out = out.withColumn("_b2", top)
    inside, levels = F.lit(True), []
    for name, value in measures().items():
        by_level = lambda zero, one, two: (F.when(F.col(f"_b0.docs_{name}") >= MIN_GROUP, zero)  # noqa: E731, B023
                                           .when(F.col(f"_b1.docs_{name}") >= MIN_GROUP, one).otherwise(two))  # noqa: B023
        low, high = (by_level(*(F.col(f"_b{k}.{end}_{name}") for k in range(3))) for end in ("low", "high"))
        inside = inside & F.coalesce(value <= high, F.lit(True)) & F.coalesce(value >= low, F.lit(True))
        levels.append(by_level(0, 1, 2))
    return (out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)
            .withColumn("level", F.greatest(*levels)).drop("_b0", "_b1", "_b2"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, level."""
    measured = materialize(measure(docs), "measures")
    bounds = materialize(fences(sketches(measured)).coalesce(1), "fences")
    return judge(measured, bounds).drop("_lang", "_source")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with their own columns."""
    bounds = materialize(fences(sketches(materialize(measure(docs), "measures"))).coalesce(1), "fences")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    slim = docs.select(row, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), text_of().alias("_text"))
    # a schema object, as column names may hold anything
    measured = slim.mapInArrow(_count, StructType([*slim.schema.fields[:-1], *StructType.fromDDL(COUNTS).fields]))
    return judge(measured, bounds).filter("kept").select("_row.*")

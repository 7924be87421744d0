"""Ranked lexical search in an index whose strata are the documents of one length normaliser.

A document's normaliser m follows from its number of terms alone, and its score for an item sums, over the item's
terms, w * ((10^9 * tf) div (1000 * tf + 8 * m)). All documents of a stratum share m, so

* a posting list is the documents of (stratum, term, tf), and its impact is computed once, when the list is made;
* the largest tf of a term in a stratum bounds what the term can add there, and the sum over an item's terms bounds
  every score of the stratum. An item visits its strata by falling bound and stops where the bound is below its
  tenth best score. A document lies in one stratum, so a visited stratum gives final scores.

Visits go in waves that widen by ``WIDEN``, so the number of jobs grows with the logarithm of the number of strata.
Lists are cut by block of ``2 ** BLOCK_BITS`` documents, so that no list grows with the table. The result is exact.

Null texts have no terms and are in no stratum. Rows with one doc_id are separate documents; rows with one item_id,
null included, are one item, whose terms are those of all its rows. Equal scores rank by doc_id, nulls first. Empty
tables give an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.texts import slices, text_of, words_of
from logfold.session import materialize

BLOCK_BITS = 17
FIRST_WAVE, WIDEN = 8, 8
#: Files of written weights and waves at most.
WAVE_FILES = 8
#: Bits of the filter that keeps words no item asks for out of the index; false ones are dropped by a join.
FILTER_BITS = 1 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Every ASCII character but letters and digits becomes a space, A-Z become a-z, bytes of other characters stay.
_FOLD = bytes(c if c >= 128 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """The same texts with their terms in lower case and nothing but spaces between them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = bytes(memoryview(data)[ends[0]:ends[-1]]) if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(raw.translate(_FOLD)))


def terms_of(batch: pa.RecordBatch, wanted: np.ndarray | None) -> pa.RecordBatch:
    """doc_id, n, and the distinct terms of each text with their tf; only those that pass the filter, if there is one."""
    codes, known, offsets = words_of(folded(batch.column("_text")))
    n = np.diff(offsets)
    if wanted is not None and len(known):
        slots = np.fromiter((zlib.crc32(w.encode()) % FILTER_BITS for w in known.to_pylist()), np.int64, len(known))
        passes = wanted[slots][codes]
    else:
        passes = np.ones(len(codes), bool)
    row = np.repeat(np.arange(len(n)), n)[passes]
    pairs, tf = np.unique(row * max(len(known), 1) + codes[passes], return_counts=True)
    row, code = np.divmod(pairs, max(len(known), 1))
    ends = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
    words = known.cast(pa.string()).take(pa.array(code))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))],
        names=["doc_id", "n", "terms", "tfs"])


def documents_terms(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """row, doc_id, n, terms, tfs of every document, written once; row is a number that is unique in this table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield terms_of(batch, wanted)

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_of().alias("_text")).mapInArrow(
        run, f"doc_id {kind}, n long, terms array<string>, tfs array<long>")
    return materialize(read.withColumn("row", F.monotonically_increasing_id()), "terms")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the terms of every item with their number of repeats."""
    asked = documents_terms(items.select(F.col("item_id").alias("doc_id"), "text"))
    spread = asked.select(F.col("doc_id").alias("item_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return materialize(spread.groupBy("item_id", F.col("x.terms").alias("term")).agg(F.sum("x.tfs").alias("times")), "asked")


def term_filter(vocabulary: DataFrame) -> np.ndarray:
    """A bit for each slot that a term of the vocabulary falls on: at most FILTER_BITS numbers, whatever its size."""
    slots = vocabulary.select((F.crc32(F.col("term").cast("binary")) % FILTER_BITS).alias("slot")).distinct()
    wanted = np.zeros(FILTER_BITS, bool)
    wanted[[r.slot for r in slots.collect()]] = True
    return wanted


def build(docs: DataFrame, vocabulary: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(index, N). The index has one row for each stratum m, block, term and tf with its impact and documents.

    With a ``vocabulary`` (term) only lists of those terms are made; strata and N still follow from all documents.
    """
    read = documents_terms(docs, None if vocabulary is None else term_filter(vocabulary))
    total = read.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    many, length = total["n"], total["l"] or 1
    posts = (read.select("row", "doc_id", F.expr(f"25 + (75 * n * {many}L) div {length}L").alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
             .select("m", F.shiftright("row", BLOCK_BITS).alias("block"), F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "row", "doc_id"))
    if vocabulary is not None:
        posts = posts.join(vocabulary, "term", "left_semi")
    # ranges of m, so that files hold neighbouring strata and visits skip the others; the grouping needs no further shuffle
    lists = (posts.repartitionByRange("m", "block").groupBy("m", "block", "term", "tf")
             .agg(F.collect_list(F.struct("row", "doc_id")).alias("docs"))
             .withColumn("impact", _impact("tf", "m")).sortWithinPartitions("m", "term", F.desc("tf")))
    return materialize(lists, "strata"), many


def _impact(tf: str, m: str):
    return F.expr(f"(1000000000L * {tf}) div (1000 * {tf} + 8 * {m})")


def weigh(asked: DataFrame, index: DataFrame, many: int) -> DataFrame:
    """item_id, term, weight: the term's weight times its repeats in the item; terms in no document are left out."""
    found = index.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * many + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = asked.join(found, "term").select("item_id", "term", (weight * F.col("times")).alias("weight"))
    return materialize(weights.coalesce(WAVE_FILES), "weights")


def bounds(weights: DataFrame, index: DataFrame) -> DataFrame:
    """item_id, m, bound and at, the place of the stratum in the item's visiting order."""
    tops = materialize(index.groupBy("term", "m").agg(F.max("tf").alias("tf")), "tops")
    each = weights.join(tops, "term").withColumn("most", F.col("weight") * _impact("tf", "m"))
    pairs = each.groupBy("item_id", "m").agg(F.sum("most").alias("bound")).filter("bound > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("bound"), "m")
    return materialize(pairs.withColumn("at", F.row_number().over(order)), "bounds")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visit(wave: DataFrame, weights: DataFrame, index: DataFrame) -> DataFrame:
    """item_id, row, doc_id, score of all documents in the visited strata that hold a term of the item.

    A document is in one stratum and block, so lists dealt by these give whole scores without moving what they add; items'
    terms and the wave are broadcast where they are small.
    """
    lists = index.join(wave.select("m").distinct(), "m", "left_semi").repartition("m", "block")
    asked = wave.select(F.col("item_id").alias("_item"), F.col("m").alias("_m"))
    met = lists.join(weights, "term").join(asked, _same("item_id", "_item") & (F.col("m") == F.col("_m")))
    met = met.select("item_id", "m", "block", (F.col("weight") * F.col("impact")).alias("adds"), F.explode("docs").alias("d"))
    scored = met.groupBy("item_id", "m", "block", "d.row", "d.doc_id").agg(F.sum("adds").alias("score"))
    return scored.select("item_id", "row", "doc_id", "score").filter("score > 0")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, by falling score and then by doc_id."""
    asked = item_terms(items)
    index, many = build(docs, asked.select("term").distinct())
    weights = weigh(asked, index, many)
    pairs = bounds(weights, index)
    visited, width, best = 0, FIRST_WAVE, None
    todo = pairs
    while True:
        wave = todo.filter(F.col("at") <= visited + width)
        # written, so that its true size decides about a broadcast
        found = _visit(materialize(wave.select("item_id", "m").coalesce(WAVE_FILES), "wave"), weights, index)
        best = materialize(_best(found if best is None else found.unionByName(best.drop("rank")), k), "best")
        visited, width = visited + width, width * WIDEN
        least = best.filter(F.col("rank") == k).select(F.col("item_id").alias("_item"), F.col("score").alias("least"))
        # a stratum whose bound equals the last score may hold a smaller doc_id
        todo = (pairs.filter(F.col("at") > visited).join(least, _same("item_id", "_item"), "left")
                .filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select(*pairs.columns))
        if todo.isEmpty():
            return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

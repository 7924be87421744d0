"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in time linear in
the document by 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Inputs: the share of each hashed lower-case word, one-hot classes of structure statistics (capitals, symbols,
other marks, repeated words, repeated lines, word length, separators) and of metadata (length of the text in
words, characters and bytes per character). Never labels, language, source or id.

The model is fitted in one Spark task on at most about ``max_rows`` labelled rows, chosen by a hash of doc_id,
and has a fixed size (``BUCKETS`` by ``FACTORS``), so it is sent to the executors whole. Without labels of both
classes the score is the smoothed share of label 1.

Null and empty texts are scored by their structure alone. A doc_id labelled twice counts as 1 if at least half of
its labels are 1; null ids and labels are left out of training. Repeated rows are scored one by one. Very long
texts are read whole. Other columns of the input are kept by ``filter_documents`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logfold.llm.texts import slices, text_of, words_of
from logfold.session import materialize

BUCKETS = 1 << 14
FACTORS = 8
#: Classes of each structure statistic; their indices follow the hashed words.
CLASSES = 24
STATS = 9
SIZE = BUCKETS + STATS * CLASSES
#: Upper ends of the classes of a share.
STEPS = np.array([0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
#: Labelled rows to fit on, about, at most.
MAX_ROWS = 6000
#: score at which a document counts as good.
GOOD = 0.3
EPOCHS, RATE, DECAY, BATCH = 15, 0.1, 1e-5, 64


def hashed(dictionary: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) % BUCKETS for w in dictionary.to_pylist()), np.int64, len(dictionary))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, offsets): row i has the inputs index[offsets[i]:offsets[i + 1]], distinct, with their values."""
    texts = pc.fill_null(texts, "")
    codes, known, offsets = words_of(texts, lower=True)
    bucket = hashed(known)[codes] if len(codes) else np.zeros(0, np.int64)
    n = len(texts)
    words = np.diff(offsets)
    chars = pc.utf8_length(texts).to_numpy().astype(np.float64)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy()
    letters = np.maximum(chars - count(r"[\x20\x09-\x0D]"), 1)
    distinct = np.array([len(np.unique(codes[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.float64)
    same_next = np.zeros(n)
    if len(codes) > 1:
        pair = np.concatenate(([0], np.cumsum(codes[1:] == codes[:-1])))
        starts, ends = np.minimum(offsets[:-1], len(codes) - 1), np.maximum(offsets[1:] - 1, 0)
        same_next = np.where(words > 1, pair[np.minimum(ends, len(codes) - 1)] - pair[starts], 0)
    lines, twice = np.zeros(n), np.zeros(n)
    for row, text in enumerate(texts.to_pylist()):
        full = [x for x in text.split("\n") if x]
        lines[row], twice[row] = len(full), len(full) - len(set(full))
    per_word = np.maximum(words, 1)
    share = lambda x: np.searchsorted(STEPS, x)  # noqa: E731  0 only for none
    stats = [
        share(count("[A-Z]") / letters), share(count(r"[#*$%&|<>]") / per_word), share(count(r"[!?=_~^{}\[\]/\\@]") / per_word),
        share(same_next / per_word), share(twice / np.maximum(lines, 1)), share(1 - distinct / per_word),
        np.minimum(letters / per_word, 23).astype(np.int64), np.minimum(np.log2(words + 1), 23).astype(np.int64),
        np.clip(10 * (pc.binary_length(texts).to_numpy() / np.maximum(chars, 1) - 1), 0, 23).astype(np.int64)]
    index, value, ends = [], [], [0]
    for row in range(n):
        own, times = np.unique(bucket[offsets[row]:offsets[row + 1]], return_counts=True)
        index.append(own)
        value.append(times / max(1, words[row]))
        index.append(np.array([BUCKETS + k * CLASSES + min(int(s[row]), CLASSES - 1) for k, s in enumerate(stats)], np.int64))
        value.append(np.ones(len(stats)))
        ends.append(ends[-1] + len(own) + len(stats))
    return np.concatenate(index), np.concatenate(value), np.array(ends)


def logits(model: dict[str, np.ndarray], index: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The machine's output for each row, in time linear in the inputs."""
    if len(offsets) < 2:
        return np.zeros(0)
    scaled = model["v"][index] * value[:, None]
    begin = offsets[:-1]
    summed = np.add.reduceat(scaled, begin)
    return (model["w0"][0] + np.add.reduceat(model["w"][index] * value, begin)
            + 0.5 * (summed ** 2 - np.add.reduceat(scaled ** 2, begin)).sum(axis=1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, good: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by mini-batches with adaptive step sizes on the logistic loss."""
    share = (good.sum() + 1) / (len(good) + 2) if len(good) else 0.5
    draw = np.random.default_rng(seed)
    model = {"w0": np.array([np.log(share / (1 - share))]), "w": np.zeros(SIZE), "v": np.zeros((SIZE, FACTORS))}
    if len(np.unique(good)) < 2:
        return model
    model["v"] = draw.normal(0, 0.02, (SIZE, FACTORS))
    seen_w, seen_v = np.full(SIZE, 1e-3), np.full((SIZE, FACTORS), 1e-3)
    for _ in range(EPOCHS):
        order = draw.permutation(len(good))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            own = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
            lengths = offsets[rows + 1] - offsets[rows]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            i, x = index[own], value[own]
            error = (sigmoid(logits(model, i, x, ends)) - good[rows]) / len(rows)
            each = np.repeat(error, lengths) * x
            scaled = model["v"][i] * x[:, None]
            inner = np.repeat(np.add.reduceat(scaled, ends[:-1]), lengths, axis=0) - scaled
            hit, where = np.unique(i, return_inverse=True)
            step_w = np.bincount(where, each, len(hit)) + DECAY * model["w"][hit]
            step_v = np.stack([np.bincount(where, each * inner[:, f], len(hit)) for f in range(FACTORS)], 1) + DECAY * model["v"][hit]
            seen_w[hit] += step_w ** 2
            seen_v[hit] += step_v ** 2
            model["w"][hit] -= RATE * step_w / np.sqrt(seen_w[hit])
            model["v"][hit] -= RATE * step_v / np.sqrt(seen_v[hit])
            model["w0"] -= RATE * error.sum()
    return model


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        index, value, offsets = features(batch.column("_text"))
        yield pa.RecordBatch.from_arrays([
            batch.column("good"), batch.column("at"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(index.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value))], names=["good", "at", "index", "value"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(r["at"], r["good"], r["index"], r["value"]) for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r[0], r[2], r[3]))
    offsets = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))).astype(np.int64)
    flat = lambda k, kind: np.concatenate([np.asarray(r[k], kind) for r in rows]) if rows else np.zeros(0, kind)
    model = train(flat(2, np.int64), flat(3, np.float64), offsets, np.array([r[1] for r in rows], np.float64))
    yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([x.tobytes() for x in model.values()])], names=["part", "numbers"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict[str, np.ndarray]:
    """The model, learned from labelled documents that are not held out."""
    marks = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("good")))
    total = marks.count()
    share = min(1.0, max_rows / max(total, 1))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = marks.select("doc_id", "good", at.alias("at")).filter(F.col("at") < int(share * (1 << 30)))
    # about max_rows rows of three numbers each: bounded, whatever the tables hold
    rows = docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(chosen), "doc_id").select("good", "at", "_text")
    inputs = rows.mapInArrow(_inputs, "good double, at long, index array<int>, value array<double>")
    parts = inputs.repartition(1).mapInArrow(_fit, "part string, numbers binary")
    model = {r.part: np.frombuffer(r.numbers) for r in materialize(parts, "machine").collect()}
    if not model:
        return train(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    return {**model, "v": model["v"].reshape(SIZE, FACTORS)}


def scored(rows: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Replace the last column, _text, by the score."""
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            values = sigmoid(logits(sent.value, *features(batch.column("_text"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(values)],
                                             names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    rows = docs.select("doc_id", text_of().alias("_text"))
    out = scored(rows, fit(docs, labels, max_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents with a score of at least ``GOOD``, with their own columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, text_of().alias("_text"))
    return scored(rows, fit(docs, labels, max_rows)).filter(F.col("score") >= GOOD).select("_row.*")

"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where encodings agree.

A text of up to ``CHUNK`` characters is encoded whole. A longer one is cut into chunks of ``CHUNK`` characters that
run ``overlap`` characters into the next. Both chunks of an overlap are encoded with offsets, and the splice is the
first place where both have a token boundary that is proven stable. A boundary before a space that follows another
character is stable: no piece of the vocabulary has a space after another character (``has_stable_spaces`` looks
at all of them), so no merge ever crosses it and the tokens on either side do not depend on each other. Where an
overlap has no such place, its chunk is encoded again with an overlap four times as wide, until it reaches the end
of the text.

Chunks of one text are rows of their own, so a huge text is spread over tasks, and memory is bounded by a chunk.
Null text: no tokens and no bytes. Repeated rows and ids are counted one by one. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.encoding import vocabulary
from logfold.llm.texts import slices, text_of
from logfold.session import materialize

CHUNK, OVERLAP = 32_000, 512


@functools.cache
def processor(file: str):  # noqa: ANN201
    """One encoder for all tasks of a Python worker."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=vocabulary(file))
    if not has_stable_spaces(own):
        raise ValueError(f"{file} has pieces with a space inside: no boundary is proven stable")
    return own


def has_stable_spaces(own) -> bool:  # noqa: ANN001
    """Whether no piece has a space after another character."""
    pieces = (own.id_to_piece(i) for i in range(own.vocab_size()))
    return all("▁" not in p.lstrip("▁") for p in pieces)


def boundaries(own, text: str) -> tuple[np.ndarray, int]:  # noqa: ANN001
    """(begin of each token in characters, number of tokens) of a text encoded alone."""
    offsets = own.encode(text, return_type="offset_mapping")["offsets"]
    return np.fromiter((begin for begin, _ in offsets), np.int64, len(offsets)), len(offsets)


def stable(text: str, begins: np.ndarray, low: int, high: int) -> tuple[list[int], list[int]]:
    """(places, tokens before them) of the stable token boundaries with low <= place < high."""
    first, last = np.searchsorted(begins, (low, high))
    places, before, seen = [], [], -1
    for k in range(int(first), int(last)):
        at = int(begins[k])
        # a space that is itself spelled as U+2581 counts as one for the library
        if at > 0 and at != seen and text[at] in " ▁" and text[at - 1] not in " ▁":
            places.append(at)
            before.append(k)
        seen = at
    return places, before


def _count(file: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(file)
        for batch in slices(batches, "_text", 4 << 20):
            texts = batch.column("_text")
            counts = [len(own.encode(x, return_type="numpy")) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _encode_chunks(file: str, chunk: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(file)
        for batch in slices(batches, "_text", 4 << 20):
            out = []
            for uid, i, wide, final, text in zip(*(batch.column(k).to_pylist() for k in ("uid", "i", "wide", "final", "_text")), strict=True):
                begins, total = boundaries(own, text)
                head = stable(text, begins, 0, wide) if i else ([], [])
                tail = stable(text, begins, chunk, chunk + wide) if not final else ([], [])
                # places are told as distances from the begin of the overlap
                out.append({"uid": uid, "i": i, "wide": wide, "final": final, "total": total, "head": head[0], "head_k": head[1],
                            "tail": [x - chunk for x in tail[0]], "tail_k": tail[1]})
            yield pa.RecordBatch.from_pylist(out, schema=batch_schema)

    batch_schema = pa.schema([("uid", pa.int64()), ("i", pa.int64()), ("wide", pa.int64()), ("final", pa.bool_()), ("total", pa.int64()),
                              *((k, pa.list_(pa.int64())) for k in ("head", "head_k", "tail", "tail_k"))])
    return run, "uid long, i long, wide long, final boolean, total long, head array<long>, head_k array<long>, tail array<long>, tail_k array<long>"


def _chunks(longs: DataFrame, wanted: DataFrame | None, chunk: int, overlap: int, file: str) -> DataFrame:
    """Encoded chunks: all with the given overlap, or those wanted (uid, i, wide)."""
    if wanted is None:
        last = F.floor((F.length("_text") - 1) / chunk)
        rows = longs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn("wide", F.lit(overlap).cast("long"))
    else:
        rows = longs.join(wanted, "uid")
    begin = F.col("i") * chunk
    cut = rows.select("uid", "i", "wide", (begin + chunk + F.col("wide") >= F.length("_text")).alias("final"),
                      F.substring("_text", (begin + 1).cast("int"), (chunk + F.col("wide")).cast("int")).alias("_text"))
    # dealt anew, so that the chunks of one text are encoded by many tasks
    run, schema = _encode_chunks(file, chunk)
    return cut.repartition("uid", "i").mapInArrow(run, schema)


def long_counts(longs: DataFrame, file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """uid, n_tokens of the long texts (uid, _text)."""
    chunks = materialize(_chunks(longs, None, chunk, overlap, file), "chunks")
    while True:
        # a chunk that reaches the end of its text takes all there is; chunks behind the first such are not needed
        end = chunks.filter("final").groupBy("uid").agg(F.min("i").alias("stop"))
        used = chunks.join(end, "uid").filter("i <= stop")
        after = used.select("uid", (F.col("i") - 1).alias("i"), "head", "head_k")
        pairs = used.filter("NOT final").select("uid", "i", "wide", "tail", "tail_k").join(after, ["uid", "i"])
        splice = F.array_min(F.array_intersect("tail", "head"))
        pairs = pairs.withColumn("at", splice)
        failed = materialize(pairs.filter("at IS NULL").select("uid", "i", (4 * F.col("wide")).alias("wide")), "failed")
        if failed.isEmpty():
            break
        # both chunks of the overlap are encoded again: the left one reaches further, the right one looks further
        right = failed.select("uid", (F.col("i") + 1).alias("i"), "wide")
        wanted = failed.union(right).groupBy("uid", "i").agg(F.max("wide").alias("wide"))
        redone = _chunks(longs, materialize(wanted, "wanted"), chunk, overlap, file)
        chunks = materialize(chunks.join(wanted, ["uid", "i"], "left_anti").unionByName(redone), "chunks")
    index = lambda places, k: F.element_at(k, F.array_position(places, F.col("at")).cast("int"))
    ends = pairs.select("uid", "i", index("tail", F.col("tail_k")).alias("upto"))
    begins = pairs.select("uid", (F.col("i") + 1).alias("i"), index("head", F.col("head_k")).alias("since"))
    parts = used.select("uid", "i", "total").join(ends, ["uid", "i"], "left").join(begins, ["uid", "i"], "left")
    return parts.groupBy("uid").agg(F.sum(F.coalesce("upto", "total") - F.coalesce("since", F.lit(0))).alias("n_tokens"))


def token_counts(docs: DataFrame, file: str = "piece_bpe_32k.model", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per document."""
    rows = docs.select("doc_id", text_of().alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = rows.filter(F.length("_text") <= chunk).mapInArrow(_count(file), f"doc_id {kind}, n_bytes long, n_tokens long")
    longs = materialize(rows.filter(F.length("_text") > chunk).withColumn("uid", F.monotonically_increasing_id()), "longs")
    counted = long_counts(longs.select("uid", "_text"), file, chunk, overlap)
    named = longs.select("uid", "doc_id", F.octet_length("_text").cast("long").alias("n_bytes")).join(counted, "uid")
    both = short.unionByName(named.drop("uid"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)

"""BPE encoding and decoding through a table of distinct words.

1. Documents are put into blocks of about ``BLOCK`` bytes of text, which travel compressed.
2. Each block's distinct words are dealt into buckets by a hash. A bucket is a part of the table of distinct words:
   it meets the words of all blocks, encodes each distinct one once with the library, and looks up the pieces of its
   ids in the id-to-piece table, whose size is that of the vocabulary.
3. Ids and pieces go back to their blocks and are put in place by the position of each word in the texts.

The number of buckets grows with the text, so a bucket stays bounded; a frequent word is one entry per block. The
library drops white space and merges nothing across it, so the ids of a text are those of its words in order;
the tokenizer has no decoder, so decoding joins pieces with one space.

Null text: empty, no ids, decoded to the empty text. Repeated rows and ids are encoded one by one. A very long text
is a block of its own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.encoding import word_encoder
from logfold.llm.texts import slices, text_of, words_of

#: Bytes of text in a block, and for each bucket of the word table.
BLOCK, BUCKET = 16 << 20, 16 << 20
FEWEST_BUCKETS = 64
#: Words of a document that are joined at once.
AT_ONCE = 1 << 20


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(texts: list[str]) -> bytes:
    """Sizes and bytes of strings, compressed."""
    data = [x.encode() for x in texts]
    return _press(np.array([len(data), *map(len, data)], "<u4").tobytes() + b"".join(data))


def _unpacked(blob: bytes) -> pa.Array:
    raw = _expand(blob)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", count, 4), dtype=np.int64)))
    return pa.Array.from_buffers(pa.string(), count, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw[4 + 4 * count:])])


def _block_words(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, pa.Array, list[np.ndarray]]:
    """(codes, offsets, words, for each bucket the numbers of its words)."""
    special = pc.any(pc.match_substring(texts, "<|")).as_py()
    codes, known, offsets = words_of(texts, lower=not special)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in known.to_pylist()), np.int64, len(known))
    order = np.argsort(hashed, kind="stable")
    order = order[np.asarray(pc.binary_length(known))[order] > 0] if len(order) else order
    return codes, offsets, known, np.split(order, np.searchsorted(hashed[order], np.arange(1, buckets)))


def blocks(docs: DataFrame) -> DataFrame:
    """block, ids and texts: documents in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "_text", BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type)),
                                              pa.array([_packed(batch.column("_text").to_pylist())], pa.binary())], names=["block", "ids", "texts"])
            number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(run, f"block long, ids array<{kind}>, texts binary")


def _deal(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
                _, _, known, parts = _block_words(_unpacked(texts.as_py()), buckets)
                used = [k for k in range(buckets) if len(parts[k])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(used), pa.int64()), pa.array(used, pa.int64()),
                    pa.array([_packed(known.take(pa.array(parts[k])).to_pylist()) for k in used], pa.binary())], names=["block", "bucket", "words"])

    return run


def _encode(file: str):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        """One bucket of the word table: the ids of every block's words, each distinct word encoded once."""
        lists = [_unpacked(x.as_py()) for x in table.column("words")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids, sizes = word_encoder(file).of_words(coded.dictionary.to_pylist())
        ends = np.cumsum(sizes)
        codes, at, blobs = coded.indices.to_numpy(), 0, []
        for own in lists:
            mine = codes[at:at + len(own)]
            at += len(own)
            size = sizes[mine]
            flat = np.arange(int(size.sum())) + np.repeat((ends - sizes)[mine] - (np.cumsum(size) - size), size)
            blobs.append(_press(np.concatenate(([len(own)], size, ids[flat])).astype("<u4").tobytes()))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ids": pa.array(blobs, pa.binary())})

    return run


def _join(strings: pa.Array, codes: np.ndarray) -> bytes:
    """The strings of the codes with one space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), strings.take(pa.array(codes))), b" ")[0].as_py()


def _digest(strings: pa.Array, codes: np.ndarray) -> str:
    found = hashlib.sha256()
    for at in range(0, len(codes), AT_ONCE):
        found.update((b" " if at else b"") + _join(strings, codes[at:at + AT_ONCE]))
    return found.hexdigest()


def _place(file: str, buckets: int, kind: pa.DataType):  # noqa: ANN202
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Ids and pieces by the position of the words in the block's texts."""
        vocabulary = word_encoder(file).tokenizer
        pieces = pa.array([vocabulary.id_to_token(i) or "" for i in range(vocabulary.get_vocab_size())], pa.string()).cast(pa.binary())
        numbers = pa.array([str(i) for i in range(len(pieces))], pa.string()).cast(pa.binary())
        back = dict(zip(right.column("bucket").to_pylist(), right.column("ids"), strict=True))
        out = []
        for doc_ids, texts in zip(left.column("ids"), left.column("texts"), strict=True):
            codes, offsets, known, parts = _block_words(_unpacked(texts.as_py()), buckets)
            sizes = np.zeros(len(known), np.int64)
            order, ids = [], []
            for bucket, own in enumerate(parts):
                if len(own):
                    raw = np.frombuffer(_expand(back[bucket].as_py()), "<u4")
                    sizes[own] = raw[1:1 + raw[0]]
                    order.append(own)
                    ids.append(raw[1 + raw[0]:])
            order = np.concatenate(order) if order else np.zeros(0, np.int64)
            ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            ends = np.concatenate(([0], np.cumsum(sizes[order])))
            where = np.zeros(len(known), np.int64)
            where[order] = np.arange(len(order))
            # a word of white space of other alphabets has no ids and leaves no trace
            full = sizes[codes] > 0
            codes, offsets = where[codes[full]], np.concatenate(([0], np.cumsum(full)))[offsets]
            total = np.concatenate(([0], np.cumsum(sizes[order][codes])))
            joined = [pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.take(pa.array(ids.astype(np.int64)))), b" ") for x in (numbers, pieces)]
            rows = list(zip(offsets[:-1], offsets[1:], strict=True))
            out.append(pa.table({
                "doc_id": pa.array(doc_ids.as_py(), kind), "n_tokens": pa.array([int(total[b] - total[a]) for a, b in rows], pa.int64()),
                **{name: pa.array([_digest(x, codes[a:b]) for a, b in rows], pa.string())
                   for name, x in zip(("ids_sha256", "decoded_sha256"), joined, strict=True)}}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], kind), "n_tokens": pa.array([], pa.int64()),
                                                           "ids_sha256": pa.array([], pa.string()), "decoded_sha256": pa.array([], pa.string())})

    return run


def encode_decode(docs: DataFrame, file: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; one row per document."""
    from pyspark.sql.pandas.types import to_arrow_type

    size = docs.select(F.sum(F.octet_length("text")).alias("n")).head().n or 0
    buckets = max(FEWEST_BUCKETS, math.ceil(size / BUCKET))
    # dealt by block once; both readers below use the same shuffle
    held = blocks(docs).repartition("block")
    words = held.mapInArrow(_deal(buckets), "block long, bucket long, words binary")
    back = words.groupBy("bucket").applyInArrow(_encode(file), "block long, bucket long, ids binary")
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return held.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_place(file, buckets, to_arrow_type(kind)), schema)

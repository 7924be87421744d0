"""Token ids in wavelet matrices, one per shard.

A shard holds the ids of consecutive documents. Its symbols are numbered by falling frequency and written as
bit-planes, the highest first; after each plane the symbols are parted stably by its bit. With counts of ones per
block of ``BLOCK`` bits, any id can be read, and occurrences counted and found, without decoding the rest.

Bytes of a shard, all numbers little-endian: ``WMX1``; long tokens, documents, alphabet size, planes; then blocks,
each a long size and zstd data: the alphabet (uint32, by rank), document ids (int64), document id present (uint8),
document sizes (int64), and for each plane its bits (packed, highest bit first) and its block counts (uint32).

Null text: the end id alone. Null doc_id: first, and read back as null. Rows that share a doc_id follow each other by
a hash of their text. A very long text is one document of a larger shard. An empty table gives no shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logfold.llm.encoding import END, SLICE, in_order, word_encoder
from logfold.llm.texts import slices
from logfold.session import materialize, scratch_path

#: Tokens at which a shard is closed.
SHARD = 1 << 20
BLOCK = 512
TABLE = "part int, seq long, n_tokens long, n_docs long, payload binary"
_MAGIC = b"WMX1"


class WaveletMatrix:
    """A sequence of ids with access, rank and select; ``doc_ids`` and ``sizes`` name its documents."""

    def __init__(self, alphabet: np.ndarray, length: int, packed: list[np.ndarray], counts: list[np.ndarray],
                 doc_ids: np.ndarray, present: np.ndarray, sizes: np.ndarray):
        self.alphabet, self.length, self.packed, self.counts = alphabet, length, packed, counts
        self.doc_ids, self.present, self.sizes = doc_ids, present, sizes

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, present: np.ndarray, sizes: np.ndarray) -> WaveletMatrix:
        times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        used = np.flatnonzero(times)
        alphabet = used[np.argsort(-times[used], kind="stable")].astype(np.uint32)
        number = np.zeros(len(times) or 1, np.uint32 if len(alphabet) > 1 << 16 else np.uint16)
        number[alphabet] = np.arange(len(alphabet))
        symbols = number[ids]
        packed, counts = [], []
        for level in range(max(1, int(len(alphabet) - 1).bit_length()) - 1, -1, -1):
            bits = (symbols & symbols.dtype.type(1 << level)) != 0
            packed.append(np.packbits(bits))
            ones = np.bitwise_count(np.pad(packed[-1], (0, -len(packed[-1]) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            counts.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
            parted, zeros = np.empty_like(symbols), len(symbols) - int(counts[-1][-1])
            np.compress(bits, symbols, out=parted[zeros:])
            np.compress(np.logical_not(bits, out=bits), symbols, out=parted[:zeros])
            symbols = parted
        return cls(alphabet, len(ids), packed, counts, doc_ids, present, sizes)

    def to_bytes(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        blocks = [self.alphabet.astype("<u4"), self.doc_ids.astype("<i8"), self.present.astype("u1"), self.sizes.astype("<i8")]
        for bits, counts in zip(self.packed, self.counts, strict=True):
            blocks += [bits, counts.astype("<u4")]
        data = [press(x.tobytes()) for x in blocks]
        head = _MAGIC + struct.pack("<4q", self.length, len(self.sizes), len(self.alphabet), len(self.packed))
        return head + b"".join(struct.pack("<q", len(x)) + x for x in data)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix")
        length, _, _, planes = struct.unpack_from("<4q", data, 4)
        at, blocks, expand = 36, [], zstandard.ZstdDecompressor().decompress
        for _ in range(4 + 2 * planes):
            size, = struct.unpack_from("<q", data, at)
            blocks.append(expand(data[at + 8:at + 8 + size]))
            at += 8 + size
        kinds = ["<u4", "<i8", "u1", "<i8", *["u1", "<u4"] * planes]
        alphabet, doc_ids, present, sizes, *rest = (np.frombuffer(x, k) for x, k in zip(blocks, kinds, strict=True))
        return cls(alphabet, length, rest[::2], rest[1::2], doc_ids, present, sizes)

    @cached_property
    def zeros(self) -> list[int]:
        return [self.length - int(c[-1]) for c in self.counts]

    @cached_property
    def _number(self) -> dict[int, int]:
        return {int(x): k for k, x in enumerate(self.alphabet)}

    def _bit(self, plane: int, at: int) -> int:
        return int(self.packed[plane][at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, plane: int, before: int) -> int:
        """Ones of a plane before a place: the count of its block and a look at part of one block."""
        block = before // BLOCK
        part = np.unpackbits(self.packed[plane][block * BLOCK // 8:(before + 7) // 8])[:before - block * BLOCK]
        return int(self.counts[plane][block]) + int(part.sum())

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.length:
            raise IndexError(at)
        symbol = 0
        for plane in range(len(self.packed)):
            bit, ones = self._bit(plane, at), self._ones(plane, at)
            at = self.zeros[plane] + ones if bit else at - ones
            symbol = symbol << 1 | bit
        return int(self.alphabet[symbol])

    def _range(self, token: int, until: int) -> tuple[int, int] | None:
        symbol = self._number.get(token)
        if symbol is None:
            return None
        begin, end, planes = 0, until, len(self.packed)
        for plane in range(planes):
            low, high = self._ones(plane, begin), self._ones(plane, end)
            if symbol >> (planes - 1 - plane) & 1:
                begin, end = self.zeros[plane] + low, self.zeros[plane] + high
            else:
                begin, end = begin - low, end - high
        return begin, end

    def rank(self, token: int, until: int | None = None) -> int:
        """How often a token occurs before a place, or at all."""
        own = self._range(token, self.length if until is None else until)
        return own[1] - own[0] if own else 0

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        own = self._range(token, self.length)
        if own is None or not 0 <= k < own[1] - own[0]:
            raise IndexError(k)
        at, symbol, planes = own[0] + k, self._number[token], len(self.packed)
        for plane in range(planes - 1, -1, -1):
            bit = symbol >> (planes - 1 - plane) & 1
            at = self._find(plane, at - self.zeros[plane] if bit else at, bit)
        return at

    def _find(self, plane: int, k: int, bit: int) -> int:
        """The place of the k-th one or zero of a plane."""
        counts = self.counts[plane].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.length) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        part = np.unpackbits(self.packed[plane][block * BLOCK // 8:(block + 1) * BLOCK // 8])[:self.length - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - counts[block]])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        symbols = np.zeros(self.length, np.uint32 if len(self.packed) > 16 else np.uint16)
        for level, (packed, zeros) in enumerate(zip(self.packed[::-1], self.zeros[::-1], strict=True)):
            bits = np.unpackbits(packed, count=self.length).view(bool)
            before = np.empty_like(symbols)
            # places are several times faster than masks, as the bits of a plane are hardly ever alike for long
            before[np.flatnonzero(bits)] = symbols[zeros:] | (1 << level)
            before[np.flatnonzero(np.logical_not(bits, out=bits))] = symbols[:zeros]
            symbols = before
        return self.alphabet[symbols] if self.length else np.zeros(0, np.uint32)


def shards(docs: DataFrame, file: str = "word_bpe_49k.json", most: int = SHARD) -> DataFrame:
    """part, seq, n_tokens, n_docs and the bytes of each shard; (part, seq) follow ascending doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, names, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            known = [x is not None for x in names]
            matrix = WaveletMatrix.build(np.concatenate(ids), np.array([x or 0 for x in names], np.int64), np.array(known), np.concatenate(sizes))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": [seq], "n_tokens": [matrix.length],
                                               "n_docs": [len(names)], "payload": [matrix.to_bytes()]})

        for batch in slices(batches, "_text", SLICE):
            flat, offsets = word_encoder(file).encode(batch.column("_text"), END)
            ids.append(flat)
            sizes.append(np.diff(offsets))
            names += batch.column("doc_id").to_pylist()
            held += len(flat)
            if held >= most:
                yield close()
                seq, ids, names, sizes, held = seq + 1, [], [], [], 0
        if held:
            yield close()

    return in_order(docs).mapInArrow(run, TABLE)


def write(docs: DataFrame, path: str, file: str = "word_bpe_49k.json", most: int = SHARD) -> None:
    """Write the shards as a Parquet table of one row per shard."""
    shards(docs, file, most).write.parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids (binary, unsigned 32-bit) from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(k) for k in ("part", "seq", "payload")), strict=True):
                matrix = WaveletMatrix.from_bytes(payload.as_py())
                ends = np.concatenate(([0], np.cumsum(matrix.sizes)))
                data = pa.Array.from_buffers(pa.binary(), len(matrix.sizes), [
                    None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(matrix.decode().astype("<u4").tobytes())])
                rows = pa.RecordBatch.from_arrays([
                    pa.array(matrix.doc_ids, mask=matrix.present == 0), pa.array(np.full(len(matrix.sizes), part.as_py(), np.int32)),
                    pa.array(np.full(len(matrix.sizes), seq.as_py())), pa.array(ends[:-1]), pa.array(matrix.sizes), data],
                    names=["doc_id", "part", "seq", "inner", "n_tokens", "ids"])
                yield from (rows.slice(k, 1000) for k in range(0, rows.num_rows, 1000))

    table = spark.read.schema(TABLE).parquet(path)
    size = table.groupBy("part", "seq").agg(F.sum("n_tokens").alias("own"))
    # a number per part on top of a running sum in it, so that no window goes over all shards
    parts = size.groupBy("part").agg(F.sum("own").alias("own"))
    above = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("above"))
    inside = size.select("part", "seq", (F.sum("own").over(Window.partitionBy("part").orderBy("seq")) - F.col("own")).alias("inside"))
    base = materialize(inside.join(above, "part").select("part", "seq", (F.col("above") + F.col("inside")).alias("base")).coalesce(1), "bases")
    read = table.select("part", "seq", "payload").mapInArrow(run, "doc_id long, part int, seq long, inner long, n_tokens long, ids binary")
    return read.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, file: str = "word_bpe_49k.json") -> DataFrame:
    """Write the documents into a new folder of the shared scratch and read them back."""
    path = scratch_path(docs.sparkSession, "wavelet")
    write(docs, path, file)
    return documents(docs.sparkSession, path)

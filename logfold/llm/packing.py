"""Order-preserving packing of token streams into windows, cut by dynamic programming.

Documents are encoded and put one after the other in ascending doc_id. Cuts may fall at the ends of documents and
sentences, and inside sentences of more than ``GAP`` tokens at every ``GAP``-th token. A window costs its padding,
a cut costs ``SENTENCE`` or ``INSIDE`` tokens if it is not at the end of a document. The cheapest chain of cuts is
found in one pass: the best start of a window that ends at a place is the minimum over a sliding range of starts,
kept in a monotone queue. The last window of a stream may be split into powers of two, which need no padding.

A stream is a range of doc_id (a Spark partition), taken in blocks; the tokens after the cheapest late cut of a block
go to the next block, so windows cross blocks and documents.

Null and empty texts are documents of one token. Null ids come first. Rows that share a doc_id are packed each on its
own, in the order of a hash of their text. A very long text is cut like any other. An empty table gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logfold.llm.encoding import END, SLICE, in_order, word_encoder
from logfold.llm.texts import slices

WIDTH = 2048
GAP = 32
#: Costs of a cut at the end of a sentence and inside one, in tokens of padding.
SENTENCE, INSIDE = 6, 24
BLOCK = 1 << 18
_STOPS = (".", "!", "?", "...", ".\"", "。")


def tail(rest: int, width: int = WIDTH) -> tuple[int, list[int]]:
    """(cost, window sizes) of the tokens after the last cut: one padded window or powers of two."""
    if rest == 0:
        return 0, []
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    split = INSIDE * (len(powers) - 1)
    return (width - rest, [rest]) if width - rest < split else (split, powers)


def cuts(places: np.ndarray, prices: np.ndarray, last: bool, width: int = WIDTH) -> list[int]:
    """The ends of the windows of one block, as token counts.

    ``places`` are the possible cuts after place 0, ascending, at most ``width`` apart; the last is the end of the
    block. If the block is not the ``last`` of its stream, the cheapest chain ends within ``width`` of its end.
    """
    at = [0, *places.tolist()]
    price = [0, *prices.tolist()]
    total = [0] * len(at)  # cost of the best chain to a place, plus the place: what a later window compares
    back = [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost = total[i] + price[j] + width
        total[j] = cost
        while queue and total[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    end = at[-1]
    near = [j for j in range(len(at) - 1, -1, -1) if end - at[j] <= width]
    if last:
        best = min(near, key=lambda j: (total[j] - at[j] + tail(end - at[j], width)[0], -j))
        rest = tail(end - at[best], width)[1]
    else:
        best, rest = min(near, key=lambda j: (total[j] - at[j] - (end - at[j]), -j)), []
    chain = []
    j = best
    while j:
        chain.append(at[j])
        j = back[j]
    chain.reverse()
    for size in rest:
        chain.append((chain[-1] if chain else 0) + size)
    return chain


def choices(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, prices) of possible cuts: ``ends`` are the ends of documents, the last is that of the ids."""
    price = np.full(len(ids) + 1, INSIDE)
    sentence = np.flatnonzero(stops[np.minimum(ids, len(stops) - 1)]) + 1
    price[sentence] = SENTENCE
    price[ends] = 0
    places = np.union1d(sentence, ends)
    gaps = np.diff(np.concatenate(([0], places)))
    wide = np.flatnonzero(gaps > GAP)
    if len(wide):
        inner = (gaps[wide] - 1) // GAP
        step = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        places = np.union1d(places, np.repeat(places[wide] - gaps[wide], inner) + step * GAP)
    return places, price[places]


def pack(docs: DataFrame, file: str = "word_bpe_49k.json", width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, unsigned 32-bit); one row per piece.

    sequence_id is the stream's number times 2^32 plus the window's number in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream, window = TaskContext.get().partitionId() << 32, 0
        encoder = word_encoder(file)
        stops = np.zeros(encoder.tokenizer.get_vocab_size() + 1, bool)
        for mark in _STOPS:
            own = encoder.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(own) == 1:
                stops[own[0]] = True
        kept: list[np.ndarray] = []
        names: list = []
        rest: list[tuple[int, int, int]] = []  # tokens here, tokens before them in the document, tokens of the document

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, names, rest, window
            ids = np.concatenate(kept)
            sizes, before, whole = (np.array(x, np.int64) for x in zip(*rest, strict=True))
            ends = np.cumsum(sizes)
            chain = np.array(cuts(*choices(ids, ends, stops), last, width), np.int64)
            used = int(chain[-1]) if len(chain) else 0
            edges = np.union1d(chain, ends[ends <= used])
            begins = np.concatenate(([0], edges[:-1])) if len(edges) else edges
            doc = np.searchsorted(ends, begins, side="right")
            place = np.searchsorted(chain, begins, side="right")
            opened = np.concatenate(([0], chain))[place]
            if len(edges):
                data = pa.Array.from_buffers(pa.binary(), len(edges), [
                    None, pa.py_buffer((4 * np.concatenate(([0], edges))).astype(np.int32).tobytes()), pa.py_buffer(ids[:used].astype("<u4").tobytes())])
                rows = pa.RecordBatch.from_arrays([
                    pa.array([names[k] for k in doc], kind), pa.array(before[doc] + begins - (ends[doc] - sizes[doc])), pa.array(edges - begins),
                    pa.array(whole[doc]), pa.array(stream + window + place), pa.array(begins - opened), data],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
                yield from (rows.slice(k, 2000) for k in range(0, rows.num_rows, 2000))
            window += len(chain)
            first = int(np.searchsorted(ends, used, side="right"))
            cut = used - int(ends[first - 1] if first else 0)
            names, rest, kept = names[first:], rest[first:], [ids[used:].copy()]  # a view would hold the block
            if rest:
                rest[0] = (rest[0][0] - cut, rest[0][1] + cut, rest[0][2])

        held = 0
        kind = None
        for batch in slices(batches, "_text", SLICE):
            kind = batch.schema.field("doc_id").type
            flat, offsets = encoder.encode(batch.column("_text"), END)
            own, first = batch.column("doc_id").to_pylist(), 0
            while first < len(own):  # documents up to the one that fills a block
                until = min(len(own), max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK - held))))
                kept.append(flat[offsets[first]:offsets[until]])
                names += own[first:until]
                rest += [(n, 0, n) for n in np.diff(offsets[first:until + 1]).tolist()]
                held += int(offsets[until] - offsets[first])
                first = until
                if held >= BLOCK:
                    yield from close(False)
                    held = sum(x[0] for x in rest)
        if rest:
            yield from close(True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_order(docs).mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")

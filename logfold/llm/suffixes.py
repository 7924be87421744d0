"""Removal of long repeats by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of ``SPAN`` bytes that covers it starts a second time anywhere. Sorting every suffix would
exchange hundreds of bytes for each byte of text, so the suffixes that are sorted start at anchors, and carry the bytes
before the anchor along. Every window of SPAN bytes has one anchor, its smallest ``GRAM``-byte string by a hash (the
first of several). Equal windows have equal anchors at equal offsets, so all repeats are met at anchors:

1. ``slices`` of documents are written once, bucketed by slice, so that no later step shuffles texts;
2. anchors whose GRAM-byte string stands at no other anchor are in no repeated window: the others are the hits;
3. every slice sorts the suffixes at its hits into a run, merges equal ones, and sends it front-coded: the length of
   the prefix shared with the suffix before, and the rest;
4. a part (the suffixes whose first GRAM bytes hash alike) merges its runs with a loser tree that keeps, for every
   loser, the prefix it shares with its winner, and compares bytes beyond that only; this also gives the shared
   prefixes of the merged order;
5. windows at offset o are equal where neighbours share SPAN - o bytes forward and o bytes backward: blocks of the merged order
   against blocks of the same suffixes sorted by what stands before them. All of it is compared byte by byte;
6. the repeated stretch around each hit goes back to its slice, which cuts its texts.

An anchor string with more than ``HOT`` hits is sent as its single windows, dealt by the whole window, so that a
passage shared by a third of all documents is not one task's work; equal windows of a slice are one entry.

Null texts are empty; texts below SPAN bytes have no windows. Repeated rows and rows with one doc_id are separate
documents. An empty table gives an empty result. Further columns are ignored, whatever their names. A text is whole
in one slice however long it is; a task holds one slice, or the entries of one part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.texts import text_of
from logfold.session import materialize, scratch_path

SPAN, GRAM = 200, 64
#: Places at which the anchor of a window may stand, counted from its start.
PLACES = SPAN - GRAM + 1
SLICE_BYTES = 8 << 20
#: Hits of one anchor string beyond which its windows are dealt one by one.
HOT = 50_000
#: Entries that a part should hold, entries of a run, entries in a row of a run, positions hashed at a time.
PART, RUN, ROW, STEP = 30_000, 100_000, 32, 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


# --- anchors ----------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, step, power = data.astype(np.uint64), 1, _BASE
    while step < GRAM:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = 2 * step, power * power % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, low, high, gram) of texts data[starts[i]:ends[i]], which lie one after the other.

    The anchor at ``place`` serves the windows that start low to high bytes before it.
    """
    found = []
    for at in range(0, max(len(data) - SPAN + 1, 0), STEP):
        many = min(STEP, len(data) - SPAN + 1 - at)
        gram = gram_hashes(data[at:at + many + SPAN - 1])
        low = np.uint64((1 << 21) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        wide = 1
        while 2 * wide <= PLACES:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        least = np.minimum(least[:many], least[PLACES - wide:PLACES - wide + many])
        place = (least & low).astype(np.int64)
        # windows that cross the end of a text have no anchor
        cross = np.zeros(many + 1, np.int64)
        np.add.at(cross, np.clip(np.maximum(starts, ends - SPAN + 1) - at, 0, many), 1)
        np.add.at(cross, np.clip(ends - at, 0, many), -1)
        begin = np.flatnonzero(np.cumsum(cross[:-1]) == 0)
        if not len(begin):
            continue
        place = place[begin]
        first = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(begin) != 1)))
        last = np.concatenate((first[1:], [True]))
        place = place[first]
        found.append((place + at, place - begin[last], place - begin[first], gram[place]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    place, low, high, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    return place, low, high, gram.view(np.int64)


def _bytes_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all texts of a slice."""
    whole = texts.cast(pa.large_binary()).combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


# --- runs -------------------------------------------------------------------------------------------------------


class Run:
    """Entries of a slice in sorted order; equal ones are one entry. ``members``: (entry, text, place, low, high) of each hit or window."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray,
                 single: np.ndarray, gram: np.ndarray, parts: int):
        n, padded = len(place), np.concatenate((np.zeros(SPAN, np.uint8), data, np.zeros(SPAN, np.uint8)))
        width = (SPAN - low).astype(np.int64)
        # single windows keep the bytes of the window only, so that equal ones are equal entries
        before = np.where(single, high, np.minimum(place - offsets[text], PLACES - 1))
        ahead = padded[(place + SPAN)[:, None] + np.arange(SPAN)]
        ahead *= np.arange(SPAN) < width[:, None]
        back = padded[(place + SPAN - 1)[:, None] - np.arange(PLACES - 1)]
        back *= np.arange(PLACES - 1) < before[:, None]
        part = (gram.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        for k in np.flatnonzero(single):
            window = data[place[k] - high[k]:place[k] - high[k] + SPAN]
            part[k] = xxhash.xxh64_intdigest(window.tobytes()) % parts
        rows = np.concatenate((part.astype(">u8").view(np.uint8).reshape(n, 8), ahead, width.astype(np.uint8)[:, None], back,
                               low.astype(np.uint8)[:, None], high.astype(np.uint8)[:, None]), axis=1)
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows = rows[order]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
        entry = np.cumsum(new) - 1
        self.members = (entry, text[order], place[order], low[order], high[order])
        kept = order[new]
        self.many = np.bincount(entry) > 1
        self.part, self.width, self.low, self.high = part[kept], width[kept], low[kept], high[kept]
        self.ahead, self.back, self.before = ahead[kept], back[kept], before[kept]

    def coded(self, run: int) -> pa.RecordBatch:
        """Rows of up to ROW entries of one part. The first entry of a row is whole, the others lack what they share with the one before."""
        n = len(self.part)
        differ = self.ahead[1:] != self.ahead[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
        shared = np.concatenate(([0], np.minimum(shared, np.minimum(self.width[1:], self.width[:-1]))))
        fresh = np.concatenate(([True], np.diff(self.part) != 0))
        shared[fresh] = 0
        since = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        opens = since % ROW == 0
        skip = np.where(opens, 0, shared)
        at = np.append(np.flatnonzero(opens), n)
        spot = np.arange(SPAN)
        rest = (spot >= skip[:, None]) & (spot < self.width[:, None])
        left = np.arange(PLACES - 1) < self.before[:, None]

        def binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
            ends = np.concatenate(([0], np.cumsum(sizes)))[at].astype(np.int32)
            return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])

        each = np.ones(n, np.int64)
        small = lambda x: binary(x.astype(np.uint8), each)
        columns = {"part": pa.array(self.part[at[:-1]]), "run": pa.array(np.full(len(at) - 1, run)), "entry": pa.array(at[:-1]),
                   "shared": small(shared), "width": small(self.width), "rest": binary(self.ahead[rest], (self.width - skip)),
                   "before": small(self.before), "back": binary(self.back[left], self.before), "low": small(self.low), "high": small(self.high), "many": small(self.many)}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_RUNS = ("part long, run long, entry long, shared binary, width binary, rest binary, before binary, back binary, low binary, high binary, many binary")


def runs_of(texts: pa.ChunkedArray, hits: dict[int, bool], parts: int) -> Iterator[Run]:
    """The runs of a slice, RUN entries before merging in each; hits: anchor string by hash -> is it hot."""
    data, offsets = _bytes_of(texts)
    place, low, high, gram = anchors(data, offsets[:-1], offsets[1:])
    known = np.fromiter(hits, np.int64, len(hits))
    known.sort()
    at = np.searchsorted(known, gram)
    kept = np.zeros(len(gram), bool)
    if len(known):
        kept = known[np.minimum(at, len(known) - 1)] == gram
    place, low, high, gram = place[kept], low[kept], high[kept], gram[kept]
    hot_grams = np.sort(np.array([g for g, is_hot in hits.items() if is_hot], np.int64))
    hot = np.isin(gram, hot_grams)
    text = np.searchsorted(offsets, place, side="right") - 1
    for some in (~hot, hot):
        rows = np.flatnonzero(some)
        sizes = np.where(hot[rows], high[rows] - low[rows] + 1, 1)
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(RUN, int(sizes.sum()) + RUN, RUN), side="left") + 1 if len(rows) else []
        since = 0
        for cut in cuts:
            own, size = rows[since:cut], sizes[since:cut]
            since = min(cut, len(rows))
            if not len(own):
                continue
            own_low, own_high = low[own], high[own]
            if hot[own[0]]:  # one entry for each window
                own_low = np.concatenate([np.arange(a, b + 1) for a, b in zip(own_low, own_high, strict=True)])
                own_high, own = own_low, np.repeat(own, size)
            yield Run(data, offsets, text[own], place[own], own_low, own_high, hot[own], gram[own], parts)


# --- the merge --------------------------------------------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, since: int) -> int:
    """Length of the common prefix of a and b, which agree in their first ``since`` bytes."""
    most = min(len(a), len(b))
    if a[since:most] == b[since:most]:
        return most
    x = int.from_bytes(a[since:most], "big") ^ int.from_bytes(b[since:most], "big")
    return most - (x.bit_length() + 7) // 8


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the one before) of all strings of sorted runs, in order.

    A run is its strings and the prefix that each shares with the one before it. A loser tree: each inner node keeps the
    loser of its match and the prefix the loser shares with the winner. Whoever shares more with the last string
    given out is smaller; only of two that share as much are bytes compared, and those beyond the shared ones only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefixes = [r[1] for r in runs]
    at = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    losers, shares = [0] * k, [0] * k

    def match(a: int, a_share: int, b: int, b_share: int) -> tuple[int, int, int, int]:
        """(winner, its share, loser, its share with the winner)."""
        if head[a] is None:
            return b, b_share, a, 0
        if head[b] is None:
            return a, a_share, b, 0
        if a_share > b_share:
            return a, a_share, b, b_share
        if b_share > a_share:
            return b, b_share, a, a_share
        x, y = head[a], head[b]
        common = shared_prefix(x, y, a_share)
        if common == len(x) or common < len(y) and x[common] < y[common]:
            return a, a_share, b, common
        return b, b_share, a, common

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        a, b = play(2 * node), play(2 * node + 1)
        winner, share, losers[node], shares[node] = match(*a, *b)
        return winner, share

    if not runs:
        return
    winner, share = play(1)
    while head[winner] is not None:
        yield winner, at[winner], share
        at[winner] += 1
        mine = strings[winner]
        if at[winner] < len(mine):
            head[winner], share = mine[at[winner]], prefixes[winner][at[winner]]
        else:
            head[winner], share = None, 0
        node = (winner + k) // 2
        while node:
            winner, share, losers[node], shares[node] = match(winner, share, losers[node], shares[node])
            node //= 2


def repeated_offsets(shared: np.ndarray, back: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) offset at which each entry's window is found again, -1 where none is; entries in merged order."""
    n = len(shared)
    least, most = np.where(many, low, -1), np.where(many, high, -1)
    group = np.cumsum(shared < GRAM)
    counts, open_ones = np.bincount(group), np.bincount(group, weights=~many)
    rows = np.flatnonzero((counts[group] > 1) & (open_ones[group] > 0))
    if not len(rows):
        return least, most
    # prefixes between chosen neighbours: whole groups are chosen, so only the first of a group loses its neighbour
    shared, low, high, back = np.where(np.concatenate(([True], np.diff(group[rows]) != 0)), 0, shared[rows]), low[rows], high[rows], back[rows]
    order = np.argsort(np.ascontiguousarray(back).view(f"S{back.shape[1]}").ravel(), kind="stable")
    differ = back[order][1:] != back[order][:-1]
    behind = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), back.shape[1])))
    least_own, most_own = np.full(len(rows), -1), np.full(len(rows), -1)
    for o in range(int(low.min()), int(high.max()) + 1):
        asked = np.flatnonzero((low <= o) & (o <= high))
        if len(asked) < 2:
            continue
        forward = np.cumsum(shared < SPAN - o)
        backward = np.empty(len(rows), np.int64)
        backward[order] = np.cumsum(behind < o)
        key = forward[asked] * (len(rows) + 1) + backward[asked]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(asked), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        met = asked[twice]
        most_own[met] = o
        fresh = met[least_own[met] < 0]
        least_own[fresh] = o
    own = ~many[rows]
    least[rows[own]], most[rows[own]] = least_own[own], most_own[own]
    return least, most


_FOUND = "slice long, run long, entry long, least int, most int"


def _merge_part(rows: pa.Table) -> pa.RecordBatch:
    """The repeated offsets of all entries of one part; rows come by run and entry."""
    c = {name: rows.column(name).to_pylist() for name in rows.column_names}
    runs: list[tuple[list[bytes], list[int]]] = []
    where: list[tuple[int, list[int]]] = []
    flat = {name: [] for name in ("low", "high", "many", "before")}
    starts, backs, n = [], [], 0
    for k, run in enumerate(c["run"]):
        if not where or where[-1][0] != run:
            runs.append(([], []))
            where.append((run, []))
            starts.append(n)
        strings, prefixes = runs[-1]
        rest, at = c["rest"][k], 0
        for j, (share, width) in enumerate(zip(c["shared"][k], c["width"][k], strict=True)):
            skip = share if j else 0
            strings.append((strings[-1][:skip] if skip else b"") + rest[at:at + width - skip])
            prefixes.append(share)
            at += width - skip
        where[-1][1].extend(range(c["entry"][k], c["entry"][k] + len(c["width"][k])))
        n += len(c["width"][k])
        for name in flat:
            flat[name].append(c[name][k])
        backs.append(c["back"][k])
    one = {name: np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for name, x in flat.items()}
    back = np.zeros((n, PLACES - 1), np.uint8)
    back[np.arange(PLACES - 1) < one["before"][:, None]] = np.frombuffer(b"".join(backs), np.uint8)
    order = np.fromiter((x for r, i, share in merged(runs) for x in (r, i, share)), np.int64, 3 * n).reshape(n, 3)
    spot = np.array(starts, np.int64)[order[:, 0]] + order[:, 1]
    least, most = repeated_offsets(order[:, 2], back[spot], one["low"][spot], one["high"][spot], one["many"][spot] > 0)
    met = np.flatnonzero(most >= 0)
    entries = np.concatenate([np.array(x[1], np.int64) for x in where])[spot[met]]
    run = np.array([x[0] for x in where], np.int64)[order[met, 0]]
    return pa.RecordBatch.from_arrays([pa.array(run >> 20), pa.array(run), pa.array(entries), pa.array(least[met].astype(np.int32)), pa.array(most[met].astype(np.int32))],
                                      names=["slice", "run", "entry", "least", "most"])


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and b > a and held[-1].column("part")[0] != batch.column("part")[a]:
                yield _merge_part(pa.Table.from_batches(held))
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield _merge_part(pa.Table.from_batches(held))


# --- the job ----------------------------------------------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give every text a slice, closed at SLICE_BYTES, and a number in it."""
    here, number, size, row = TaskContext.get().partitionId(), 0, 0, 0
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).tolist()
        slices, rows = [], []
        for length in lengths:
            if size and size + length > SLICE_BYTES:
                number, size, row = number + 1, 0, 0
            slices.append((here << 20) + number)
            rows.append(row)
            size, row = size + length, row + 1
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(rows, pa.int64()), *batch.columns], names=["slice", "row", *batch.schema.names])


def write_slices(docs: DataFrame) -> tuple[str, DataFrame]:
    """(name, table) of slice, row, doc_id, text: written once, bucketed by slice, so that joining notes to the slices does not move texts."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", text_of().alias("text")).mapInArrow(_slices, f"slice long, row long, doc_id {kind}, text string")
    name = f"slices_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut.write.format("parquet").bucketBy(buckets, "slice").option("path", scratch_path(spark, "slices")).option("compression", "zstd").saveAsTable(name)
    return name, spark.table(name)


def _in_row_order(texts: pa.Table) -> pa.Table:
    return texts.sort_by("row")


def _grams(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
    data, offsets = _bytes_of(_in_row_order(texts).column("text"))
    gram, times = np.unique(anchors(data, offsets[:-1], offsets[1:])[3], return_counts=True)
    return pa.table({"slice": pa.array(np.full(len(gram), key[0].as_py()), pa.int64()), "gram": pa.array(gram), "times": pa.array(times.astype(np.int64))})


def hits_of(texts: DataFrame) -> DataFrame:
    """slice, gram, hot: anchor strings (by hash) that stand at two anchors at least, for every slice that holds them."""
    grams = materialize(texts.groupBy("slice").applyInArrow(_grams, "slice long, gram long, times long"), "grams")
    counts = materialize(grams.groupBy("gram").agg(F.sum("times").alias("n")).filter("n > 1"), "counts")
    return materialize(grams.join(counts, "gram").select("slice", "gram", (F.col("n") > HOT).alias("hot"), "times"), "hits")


def _hits_in(notes: pa.Table) -> dict[int, bool]:
    notes = notes.filter(pc.is_valid(notes.column("gram")))
    return dict(zip(notes.column("gram").to_pylist(), notes.column("hot").to_pylist(), strict=True))


def _runs(parts: int):
    def code(key: tuple[pa.Scalar, ...], texts: pa.Table, notes: pa.Table) -> pa.Table:
        runs = enumerate(runs_of(_in_row_order(texts).column("text"), _hits_in(notes), parts)) if texts.num_rows else ()
        coded = [run.coded((key[0].as_py() << 20) + k) for k, run in runs]
        return pa.Table.from_batches(coded) if coded else pa.table({
            n: pa.array([], pa.int64() if n in ("part", "run", "entry") else pa.binary()) for n in (x.split()[0] for x in _RUNS.split(", "))})
    return code


def _cut(parts: int, doc_id: pa.DataType):
    """Remove the repeated stretches of a slice's texts; the runs are made once more, to know the members of their entries."""
    def cut(key: tuple[pa.Scalar, ...], texts: pa.Table, notes: pa.Table) -> pa.Table:
        texts = _in_row_order(texts)
        data, offsets = _bytes_of(texts.column("text"))
        gone = np.zeros(len(data) + 1, np.int32)
        found = notes.filter(pc.is_valid(notes.column("entry")))
        if found.num_rows:
            run_of, entry_of, least_of, most_of = (found.column(c).to_numpy() for c in ("run", "entry", "least", "most"))
            for k, run in enumerate(runs_of(texts.column("text"), _hits_in(notes), parts)):
                own = run_of == (key[0].as_py() << 20) + k
                least, most = np.full(len(run.part), -1), np.full(len(run.part), -1)
                least[entry_of[own]], most[entry_of[own]] = least_of[own], most_of[own]
                entry, _, place, _, _ = run.members
                met = most[entry] >= 0
                np.add.at(gone, place[met] - most[entry[met]], 1)
                np.add.at(gone, place[met] + SPAN - least[entry[met]], -1)
        removed = np.cumsum(gone[:-1]) > 0
        opens = removed & ~np.concatenate(([False], removed[:-1])) if len(removed) else removed
        opens[offsets[:-1][np.diff(offsets) > 0]] |= removed[offsets[:-1][np.diff(offsets) > 0]]
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
        digests = [hashlib.sha256(data[a:b][~removed[a:b]]).hexdigest() for a, b in zip(offsets, offsets[1:])]
        return pa.table({"doc_id": texts.column("doc_id").cast(doc_id), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(sums(removed).astype(np.int64)),
                         "n_spans": pa.array(sums(opens).astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())})
    return cut


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spark = docs.sparkSession
    name, texts = write_slices(docs)
    hits = hits_of(texts)
    entries = hits.agg(F.sum("times")).first()[0] or 0
    parts = max(1, -(-entries // PART))
    asked = hits.select("slice", "gram", "hot")
    coded = texts.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(_runs(parts), _RUNS)
    ordered = coded.repartition("part").sortWithinPartitions("part", "run", "entry")
    found = materialize(ordered.mapInArrow(_merge_parts, _FOUND), "found")
    notes = asked.unionByName(found, allowMissingColumns=True)
    field = docs.schema["doc_id"]
    doc_id = pa.int32() if field.dataType.simpleString() == "int" else pa.string() if field.dataType.simpleString() == "string" else pa.int64()
    out = f"doc_id {field.dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    result = materialize(texts.groupBy("slice").cogroup(notes.groupBy("slice")).applyInArrow(_cut(parts, doc_id), out), "kept")
    spark.sql(f"DROP TABLE {name}")
    return result

"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set is its distinct word shingles, each hashed once to 64 bits; its sketch is the ``KEPT`` smallest
hashes. Documents with equal sets are one node (equal size and two 64-bit sums over the set). Inverted lists of
retained values give overlaps, the sketch of a union estimates the similarity of a pair, and the pairs that remain
are confirmed on full sets.

No pair is lost to a cap. Retained values are ordered from rare to frequent, and a pair with the required overlap
must share one of the rarest ``size - overlap + 1`` of either side, so only these lists are opened. A list of up to
``SHORT`` nodes gives all its pairs. A longer list compares all its nodes with a few of them (``CENTRES``), and then
whatever is not in the list's largest component with every node of another component; pairs that are
already connected need no comparison, so a group of n near copies costs about n comparisons, not n^2. What is left
to compare is dealt into blocks: a task counts the values that all pairs of a block share, on whole sets, by a product
of matrices, and returns no more links than a block has components.

For sets of up to ``KEPT`` shingles the overlap bound is exact. For larger sets sketches must share half of
their values where 0.8 is expected: below that with a probability under 1e-6, for a pair exactly at the limit.

Null and empty texts, or texts without words: size 0, linked with nothing, kept. Fewer words than a shingle: the
sequence as one shingle. Documents are identified by doc_id: rows that share one are in one component, which links
the near copies of each of their texts. A null doc_id joins the component of its copies; without such copies it is kept with a null component. Very long texts are read
whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from logfold.llm.graph import components
from logfold.llm.texts import release, slices, text_of, words_of
from logfold.session import materialize

#: Values that a sketch retains, and those that sketches of similar large sets share at least.
KEPT, SHARED = 64, 32
#: Nodes in an inverted list that gives all its pairs.
SHORT = 12
#: Nodes that a longer list compares with all others, in the first and the second round.
CENTRES = (1, 12)
#: Nodes of a long list, and values of their sets, for each part that it is dealt into.
PART, PART_VALUES = 2048, 1 << 20
#: A value of a block is a column of matrices if one of so many pairs shares it; columns at once, and pairs of other values.
OFTEN, COLUMNS, PAIRS = 64, 1024, 1 << 20
#: Nodes with a list that share a file of the tables about them.
FILE_ROWS = 20_000
#: Bits of a filter for each node with a list, and at most; rows that pass it wrongly are left out by a join.
BITS, MOST_BITS = 16, 1 << 25
#: What names the set of a node among those of all documents.
_SET = ["first", "n", "s1", "s2"]
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                         0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed 64-bit numbers."""
    codes, known, offsets = words_of(texts, lower=True)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known.to_pylist()), np.uint64, len(known))[codes]
    with np.errstate(over="ignore"):
        total = max(0, len(each) - words + 1)
        rolled = np.zeros(total, np.uint64)
        for k in range(words):
            rolled += each[k:k + total] * _MULTIPLIERS[k]
        rolled = _mix(rolled).view(np.int64)
        for row in range(len(texts)):
            begin, end = offsets[row], offsets[row + 1]
            if end - begin >= words:
                yield np.unique(rolled[begin:end - words + 1])
            elif end > begin:
                own = (each[begin:end] * _MULTIPLIERS[:end - begin]).sum(dtype=np.uint64) + np.uint64(end - begin)
                yield _mix(np.array([own], np.uint64)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _identity(rows: list[np.ndarray]) -> list[pa.Array]:
    """The size and the two sums of each set."""
    with np.errstate(over="ignore"):
        return [pa.array(np.array(x, np.int64)) for x in (
            [len(own) for own in rows], [own.sum(dtype=np.int64) for own in rows],
            [_mix(own.view(np.uint64)).view(np.int64).sum(dtype=np.int64) for own in rows])]


def sketches(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, n, s1, s2 (which identify the set) and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            own = list(shingle_sets(batch.column("_text"), words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_identity(own), _lists([x[:KEPT] for x in own])],
                                             names=["doc_id", "n", "s1", "s2", "sketch"])

    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, s1 long, s2 long, sketch array<long>")


def full_sets(docs: DataFrame, words: int = 4) -> DataFrame:
    """first, n, s1, s2 and the whole set; docs has first and _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            own = list(shingle_sets(batch.column("_text"), words))
            yield pa.RecordBatch.from_arrays([batch.column("first"), *_identity(own), _lists(own)], names=["first", "n", "s1", "s2", "items"])

    return docs.mapInArrow(run, "first long, n long, s1 long, s2 long, items array<long>")


def rare_values(nodes: DataFrame, percent: int) -> DataFrame:
    """node, n, rare: the retained values that more than one node has and that a partner must share one of."""
    values = nodes.select("node", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value")).repartition("value")
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    exact = (F.col("m") * percent) <= KEPT * percent * percent / 100
    need = F.when(exact, F.ceil(F.col("m") * percent / 100)).otherwise(SHARED).cast("int")
    mine = values.join(often, "value").groupBy("node", "n", "m").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("common"))
    alone = F.col("m") - F.size("common")
    opened = F.greatest(F.lit(0), F.col("m") - need + 1 - alone).cast("int")
    rare = F.when(opened > 0, F.slice(F.col("common.value"), F.lit(1), opened))
    return mine.select("node", "n", rare.alias("rare")).filter("rare IS NOT NULL")


def _alike(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _fine(items: str) -> Column:
    """What members of a long list are compared by: all hashes of the set, in 64 bits, so that a count is no estimate."""
    return F.col(items)


def _lost(fine: str) -> Column:
    """How many of these numbers equal an earlier one, which a count of distinct ones leaves out: none, as hashes are whole."""
    return F.size(fine) - F.size(F.array_distinct(fine))


def among(rows: DataFrame, ids: DataFrame, key: list[str], bits: int, within: bool = True) -> DataFrame:
    """The rows whose key is among the ids, and a few others; with ``within`` off the rest, whose keys are not among them for certain.

    A bitmap of the keys' hashes is broadcast, a row for 64 of its ``bits``, so its size has a bound and the rows are not shuffled.
    """
    slot = F.pmod(F.xxhash64(*key), F.lit(bits).cast("long"))
    place = F.expr("CAST(_slot % 64 AS int)")
    marks = (ids.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(_slot % 64 AS int))")).alias("_marks")))
    met = rows.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(marks), "_word", "left")
    found = F.coalesce(F.getbit("_marks", place), F.lit(0)) == 1
    return met.filter(found if within else ~found).select(*rows.columns)


class _Comparer:
    """Estimates and confirms pairs of nodes, and keeps the component of every node that has a list."""

    def __init__(self, docs: DataFrame, groups: DataFrame, nodes: DataFrame, lists: DataFrame, repeated: DataFrame, words: int, percent: int):
        self.percent = percent
        wanted = materialize(lists.select("node").distinct(), "wanted")
        many = wanted.count()
        # tables with a row per node with a list go into as many files as their rows need
        self.files = max(1, math.ceil(many / FILE_ROWS))
        self.bits = min(MOST_BITS, max(64, BITS * many))
        self.nodes = self.written(nodes.join(wanted, "node"), "listed")
        # the text of a node is one of its first document, which may have others
        self.named = self.written(groups.join(wanted, "node").select("node", *_SET), "named")
        texts = among(docs.select(F.col("doc_id").cast("long").alias("first"), text_of().alias("_text")), self.named, ["first"], self.bits)
        # neither texts nor sets are shuffled here, but for those of rows that may be repeated, to leave one of each
        if repeated.isEmpty():
            sets = full_sets(texts, words)
        else:
            once, several = (full_sets(among(texts, repeated, ["first"], self.bits, within), words) for within in (False, True))
            sets = once.union(several.dropDuplicates(_SET))
        self.sets = materialize(among(sets, self.named, _SET, self.bits), "sets")
        self.labels = self.written(wanted.select("node", F.col("node").alias("component")), "labels")

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        return materialize(rows.repartition(self.files), name)

    def label(self, rows: DataFrame, end: str = "node", name: str = "component") -> DataFrame:
        """Add the component of a node."""
        return rows.join(self.labels.select(F.col("node").alias(end), F.col("component").alias(name)), end)

    def with_set(self, rows: DataFrame, tail: str = "") -> DataFrame:
        """Add the whole set that the columns of ``_SET`` with this tail name. Sets that no row needs stay where they are."""
        key = [f"{c}{tail}" for c in _SET]
        sets = self.sets.select(*(F.col(c).alias(f"{c}{tail}") for c in (*_SET, "items")))
        return rows.join(among(sets, rows, key, self.bits), key)

    def _confirm(self, pairs: DataFrame) -> None:
        """Compare whole sets, and join the components of pairs that are similar."""
        named = pairs
        for end in ("a", "b"):
            named = named.join(self.named.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in _SET)), end)
        named = self.written(named, "needed")
        both = F.size(F.array_intersect("items_a", "items_b"))
        links = self.with_set(self.with_set(named, "_a"), "_b")
        self.join(links.filter(100 * both >= self.percent * (F.size("items_a") + F.size("items_b") - both)).select("a", "b"))

    def join(self, links: DataFrame) -> None:
        """Make one component of those that links a, b connect."""
        ends = self.label(self.label(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()
        ends = self.written(ends, "links")
        if ends.isEmpty():
            return
        moved = components(ends, self.files).select(F.col("node").alias("component"), F.col("component").alias("to"))
        self.labels = self.written(self.labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")

    def compare(self, pairs: DataFrame) -> None:
        """Link those of the pairs a, b that are similar: the two closest of each b, of two components, then what is left."""
        side = lambda k: self.nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        seen = pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike(F.col("na"), F.col("nb"), self.percent))
        union = F.array_sort(F.array_union("sa", "sb"))
        whole = (F.col("na") <= KEPT) & (F.col("nb") <= KEPT)
        lowest = F.when(whole, union).otherwise(F.slice(union, 1, KEPT))
        near = F.size(F.array_intersect(F.array_intersect(lowest, F.col("sa")), F.col("sb"))) / F.size(lowest)
        close = seen.withColumn("near", near).filter(F.col("near") >= F.when(whole, self.percent / 100 - 1e-9).otherwise(SHARED / KEPT))
        rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("near"), "a"))
        close = self.written(close.select("a", "b", "near", rank.alias("rank")), "close")
        if close.isEmpty():
            return
        self._confirm(close.filter("rank <= 2").select("a", "b"))
        rest = close.filter("rank > 2").select("a", "b", "near")
        # pairs between components that the closest ones join need no comparison
        between = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.desc("near"), "a", "b")
        for most in (2, None):
            rest = self.written(self.label(self.label(rest, "a", "ca"), "b", "cb").filter("ca <> cb"), "rest")
            if rest.isEmpty():
                return
            first = rest if most is None else rest.withColumn("rank", F.row_number().over(between)).filter(F.col("rank") <= most)
            self._confirm(first.select("a", "b"))
            rest = rest.select("a", "b", "near")


def _short_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of the short lists."""
    members = lists.filter(F.col("size") <= SHORT).groupBy("value").agg(F.sort_array(F.collect_list("node")).alias("own"))
    one = members.select("own", F.posexplode("own").alias("i", "a"))
    return one.select("a", F.explode(F.expr("slice(own, i + 2, size(own))")).alias("b")).distinct()


def _open_lists(members: DataFrame) -> DataFrame:
    """value, node, n, component and most, the largest component, of the lists that are not of one component; ids only."""
    by = members.groupBy("value", "component").agg(F.count(F.lit(1)).alias("c"))
    split = by.groupBy("value").agg(F.max_by("component", "c").alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return members.join(split.select("value", "most"), "value")


def _parts() -> Column:
    """How many parts the members of a list are dealt into."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("n") / PART_VALUES)).cast("long")


def _chosen(opened: DataFrame, centres: int | None) -> DataFrame:
    """value, node, part, parts: all or ``centres`` nodes of each list outside its largest component, dealt into parts."""
    outside = opened.filter("component <> most").select("value", "node", "n")
    if centres is not None:
        order = F.row_number().over(Window.partitionBy("value").orderBy(F.xxhash64("node", "value")))
        outside = outside.withColumn("order", order).filter(F.col("order") <= centres).drop("order")
    parts = outside.groupBy("value").agg(_parts().alias("parts"))
    return outside.drop("n").join(parts, "value").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))


def _shared_counts(rows: np.ndarray, own: np.ndarray, cols: np.ndarray, other: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many values each row shares with each column, which have the values ``own`` and ``other``, numbered from 0.

    Values of many pairs are columns of two matrices whose product is taken, the pairs of others are counted one by one.
    """
    known = max(own.max(initial=-1), other.max(initial=-1)) + 1
    left, right = np.bincount(own, minlength=known), np.bincount(other, minlength=known)
    both = np.zeros(shape)
    often = left * right * OFTEN >= shape[0] * shape[1]
    columns = np.flatnonzero(often)
    for begin in range(0, len(columns), COLUMNS):
        portion = columns[begin:begin + COLUMNS]
        at = np.full(known, -1)
        at[portion] = np.arange(len(portion))
        marks = []
        for places, values, size in ((rows, own, shape[0]), (cols, other, shape[1])):
            column = at[values]
            mark = np.zeros((size, len(portion)), np.float32)
            mark[places[column >= 0], column[column >= 0]] = 1
            marks.append(mark)
        both += marks[0] @ marks[1].T
    seldom = (left > 0) & (right > 0) & ~often
    rows, own = rows[seldom[own]], own[seldom[own]]
    cols = cols[seldom[other]][np.argsort(other[seldom[other]], kind="stable")]
    start = np.cumsum(right * seldom) - right * seldom
    times = right[own]
    ends = np.cumsum(times)
    begin = 0
    while begin < len(own):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - times[begin] + PAIRS, side="right")))
        each = times[begin:end]
        place = np.repeat(start[own[begin:end]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        np.add.at(both.reshape(-1), np.repeat(rows[begin:end], each) * shape[1] + cols[place], 1.0)
        begin = end
    return both


def _block_links(block: pa.Table, percent: int) -> pa.Table:
    """Links a, b of similar sets, a chosen and b another member, that join all components of the block that such pairs join."""
    block = block.combine_chunks()
    chosen = block.column("chosen").to_numpy()
    node, component = block.column("node").to_numpy(), block.column("component").to_numpy()
    found: list[tuple[int, int]] = []
    if chosen.any() and not chosen.all():
        sets = block.column("fine").combine_chunks()
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        code = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        label = np.unique(component, return_inverse=True)[1]
        # the number of a node on its side, for each of its values
        place = np.repeat(np.where(chosen, np.cumsum(chosen), np.cumsum(~chosen)) - 1, size)
        mine = np.repeat(chosen, size)
        a, b = np.flatnonzero(chosen), np.flatnonzero(~chosen)
        both = _shared_counts(place[mine], code[mine], place[~mine], code[~mine], (len(a), len(b)))
        close = both * (100 + percent) >= percent * (size[a][:, None] + size[b])  # |A n B| of |A u B| = |A| + |B| - |A n B|
        close &= label[a][:, None] != label[b]
        for k in np.flatnonzero(close.any(axis=1)):
            others = b[close[k]]
            ends, first = np.unique(label[others], return_index=True)
            new = ends != label[a[k]]
            found += [(node[a[k]], node[x]) for x in others[first[new]]]
            label[np.isin(label, ends[new])] = label[a[k]]
    release()
    return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _close_members(opened: DataFrame, chosen: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """Links of chosen and other members of a list whose sets are similar, as many as join the components of each block.

    A block is a part of the chosen nodes and a part of all members of the list; each is copied for the parts of the
    other. Pairs are never rows: a task counts what they share, so a list of n nodes that are not similar costs n^2 steps of a product.
    """
    opened = opened.select("value", "node", "component", "n")
    members = opened.join(chosen.select("value", "parts").distinct(), "value")
    members = members.join(members.groupBy("value").agg(_parts().alias("slices")), "value")
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    some = chosen.select("value", "node", "part").join(members.drop("parts"), ["value", "node"]).select(
        "value", "part", each("slices").alias("slice"), "node", "component", F.lit(True).alias("chosen"))
    others = members.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices"))).select(
        "value", each("parts").alias("part"), "slice", "node", "component", F.lit(False).alias("chosen"))
    blocks = some.unionByName(others).join(sides.select("node", "fine"), "node")
    return blocks.groupBy("value", "part", "slice").applyInArrow(lambda block: _block_links(block, percent), "a long, b long")


def _sets_of_one_id(slim: DataFrame, groups: DataFrame) -> DataFrame:
    """Links a, b between the sets of documents that share a doc_id."""
    own = slim.filter("doc_id IS NOT NULL AND n > 0")
    one = F.struct("n", "s1", "s2")
    several = own.groupBy("doc_id").agg(F.min(one).alias("least"), F.max(one).alias("most")).filter("least <> most").select("doc_id")
    several = materialize(several, "several")
    sets = own.join(several, "doc_id").join(groups, ["n", "s1", "s2"]).select("doc_id", "node").distinct()
    least = sets.groupBy("doc_id").agg(F.min("node").alias("b"))
    return materialize(sets.join(least, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b"), "same_id")


def _components_of_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, s1, s2 of every document; n, s1, s2, first, node of every set; node, component of sets with a list)."""
    rows = materialize(sketches(docs, words), "sketches")
    key = ["n", "s1", "s2"]
    named = rows.withColumn("first", F.col("doc_id").cast("long"))
    repeated = named.filter("first IS NOT NULL").groupBy("first", *key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    repeated = materialize(repeated.select("first", *key), "repeated")
    groups = rows.filter("n > 0").groupBy(*key).agg(F.min("doc_id").cast("long").alias("first"))
    # sets are numbered, as documents that share a doc_id may have several; writing keeps the numbers
    groups = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    same = ["first", *key]
    once, several = named.join(repeated, same, "left_anti"), named.join(repeated, same, "left_semi").dropDuplicates(same)
    nodes = materialize(once.unionByName(several).join(groups, same).select("node", "n", "sketch"), "nodes")
    rare = materialize(rare_values(nodes, percent), "rare")
    lists = rare.select("node", "n", F.explode("rare").alias("value"))
    size = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    lists = materialize(lists.join(size, "value"), "lists")
    comparer = _Comparer(docs, groups, nodes, lists, repeated, words, percent)
    long_lists = lists.filter(F.col("size") > SHORT)
    # a short list costs all its pairs, a long one starts with one centre
    centre = long_lists.groupBy("value").agg(F.min_by("node", F.xxhash64("node", "value")).alias("a"))
    comparer.compare(_short_pairs(lists).union(long_lists.join(centre, "value").filter("a <> node").select("a", F.col("node").alias("b"))).distinct())
    # lists with much the same nodes mostly have the same lowest node by a hash: they become one, with all their nodes
    lowest = long_lists.groupBy("value").agg(F.min_by("node", F.xxhash64("node")).alias("list"))
    long_lists = comparer.written(long_lists.join(lowest, "value").select(F.col("list").alias("value"), "node", "n").distinct(), "merged")
    sides = comparer.with_set(comparer.written(long_lists.select("node").distinct().join(comparer.named, "node"), "needed"))
    sides = comparer.written(sides.select("node", _fine("items").alias("fine")), "sides")
    for centres in (CENTRES[1], None):
        opened = comparer.written(_open_lists(comparer.label(long_lists.select("node", "value", "n"))), "opened")
        if opened.isEmpty():
            break
        chosen = comparer.written(_chosen(opened, centres), "chosen")
        comparer.join(_close_members(opened, chosen, sides, percent))
    return rows.select("doc_id", *key), groups, comparer.labels


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document."""
    slim, groups, labels = _components_of_sets(docs, words, percent)
    key = ["n", "s1", "s2"]
    same_id = _sets_of_one_id(slim, groups)
    if not same_id.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same_id))
    named = groups.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a component is named by its smallest doc_id
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component")
    out = slim.join(named.select(*key, "component_id"), key, "left")
    component = F.coalesce("component_id", F.col("doc_id").cast("long"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _with_set(docs: DataFrame, words: int) -> DataFrame:
    """The documents as ``row``, with doc_id, _text and the n, s1, s2 of their sets."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", text_of().alias("_text"))
    schema = StructType([*rows.schema.fields, *(StructField(name, LongType()) for name in ("n", "s1", "s2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            own = list(shingle_sets(batch.column("_text"), words))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_identity(own)], names=[*batch.schema.names, "n", "s1", "s2"])

    return rows.mapInArrow(run, schema)


def keep_one(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, with its own columns: that of the smallest doc_id, of several the first by text.

    Groups are of texts: documents that share a doc_id stay if their texts are no near copies. A document without an id
    goes if its set equals another one's; documents without words all stay.
    """
    slim, groups, labels = _components_of_sets(docs, words, percent)
    key = ["n", "s1", "s2"]
    named = groups.join(labels, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)).alias("best")
    kept = slim.filter("n > 0").distinct().join(named, key).groupBy("component").agg(best)
    kept = materialize(kept.select(*(F.col(f"best.{c}").alias(f"_{c}") for c in ("doc_id", *key))), "kept")
    rows = _with_set(docs, words)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in key:
        same &= F.col(c) == F.col(f"_{c}")
    first = F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("_text"))
    chosen = rows.filter("n > 0").join(kept, same, "left_semi").withColumn("first", first).filter("first = 1").select("row.*")
    return chosen.unionByName(rows.filter("n = 0").select("row.*"))

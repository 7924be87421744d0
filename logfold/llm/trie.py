"""Prefix trie of conversations, with subtree totals by centroid decomposition of its parent edges.

Conversation c is rebuilt from the first h turns of conversation c - c % 100 and its own turns after its first h,
h = crc32(decimal c) % 6. Every distinct sequence of first turns is a node; a node is named by its smallest member
and its depth, so the node of conversation c at depth d is one lookup in a table of (c, d).

Subtree totals (leaves, saved tokens) come from the decomposition. A node weighs as many as it has members. In a
component with top t and total weight W, the nodes whose subtree weighs more than W / 2 are one chain from t down; its
last node is the centroid. Without it the component falls into the subtrees of its children and the rest above, none
heavier than half. The total of the centroid's subtree is aggregated once and added along the chain, the path from
the centroid to the top, and each piece is decomposed likewise: a trie of any depth is done in log2(weight) rounds.
Components of more than ``LOCAL`` nodes are split by joins, all at once in each round; smaller ones are recursed into,
by the same steps, inside a task, which never holds more than ``BATCH`` rows and one component.

Turns are ordered by turn, null first; turns with equal numbers by the MD5 of role and text. Null roles and texts are
empty. Rows without a conv_id belong to no conversation. Repeated rows are repeated turns. An empty table has no
nodes, not even the root. Turns are told apart by 128 bits of hashes. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.texts import text_of
from logfold.operators.ranking import rank_rows
from logfold.session import materialize

#: A component of at most so many nodes is decomposed inside one task; rows that a task decomposes together.
LOCAL, BATCH = 10_000, 50_000
#: Turns of one conversation whose hashes are combined in one window.
CHUNK = 4096
#: Ends of one node that are listed in one row; longer lists are digested piece by piece.
LISTED, PIECE = 10_000, 200
NODE = ["conv_id", "depth"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (1, 2, ...), key1, key2, chars: the turns of every conversation in order, as hashes."""
    role, text = text_of("role"), text_of("text")
    known = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", known.alias("known"), F.char_length(text).cast("long").alias("chars"))
    ranked = rank_rows(materialize(turns, "turns"), ["conv_id"], ["turn", "known"], "p")
    return materialize(ranked.select("conv_id", "p", F.xxhash64("known").alias("key1"), F.xxhash64("known", F.lit(1)).alias("key2"), "chars"), "ranked")


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """conv_id, len, depth, hash1, hash2, chars: a row for each turn of each rebuilt conversation, one of depth 0 for each.

    The hashes are those of the whole sequence up to the turn: exclusive ors of hashes of (depth, turn), which can be
    combined in any order, so a long conversation is cut into chunks.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, "base": F.expr("conv_id - conv_id % 100")})
    convs = materialize(convs, "convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.join(bases, "base", "left").select(
        "conv_id", "h", "base", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")), "rebuilt")
    own = turns.join(convs, "conv_id").filter("p > h").withColumn("depth", F.expr("taken + p - h"))
    heads = turns.filter("p <= 5").withColumnRenamed("conv_id", "base")
    lent = convs.join(heads, "base").filter("p <= taken").withColumn("depth", F.col("p"))
    parts = ["conv_id", "len", "depth", F.xxhash64("depth", "key1").alias("own1"), F.xxhash64("depth", "key2").alias("own2"), "chars",
             F.expr(f"(depth - 1) div {CHUNK}").alias("chunk")]
    rows = materialize(own.select(*parts).union(lent.select(*parts)), "rows")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    since = materialize(rows.filter(F.col("len") > CHUNK).groupBy("conv_id", "chunk").agg(F.bit_xor("own1").alias("t1"), F.bit_xor("own2").alias("t2"))
                        .select("conv_id", "chunk", F.bit_xor("t1").over(before).alias("t1"), F.bit_xor("t2").over(before).alias("t2")), "since")
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"x1": F.bit_xor("own1").over(upto), "x2": F.bit_xor("own2").over(upto)})
    whole = lambda x, t: F.col(x).bitwiseXOR(F.coalesce(t, F.lit(0)))
    paths = inside.join(since, ["conv_id", "chunk"], "left").select(
        "conv_id", "len", "depth", whole("x1", "t1").alias("hash1"), whole("x2", "t2").alias("hash2"), "chars")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", "len", zero.alias("depth"), zero.alias("hash1"), zero.alias("hash2"), zero.alias("chars"))
    return materialize(paths.union(roots), "paths")


def nodes_of(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, lookup).

    nodes: conv_id (smallest member), depth, parent (conv_id of its parent), n_convs, chars, weight (of its subtree: how often
    conversations pass a node of it). lookup: conv_id, depth, owner, parent: the node that a conversation has at a depth.
    """
    named = materialize(paths.groupBy("depth", "hash1", "hash2").agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight")), "named")
    root = paths.agg(F.min("conv_id")).first()[0]
    met = paths.filter("depth > 0").join(named.select("depth", "hash1", "hash2", "owner"), ["depth", "hash1", "hash2"]).select(*NODE, "owner", "len")
    lookup = materialize(met.union(paths.filter("depth = 0").select(*NODE, F.lit(root).cast("long"), "len")), "owners")
    above = lookup.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    lookup = materialize(lookup.join(above, NODE, "left"), "lookup")
    parents = lookup.filter("owner = conv_id").select(*NODE, "parent")
    nodes = named.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "chars", "weight").join(parents, NODE)
    return materialize(nodes, "nodes"), lookup


# --- the decomposition inside a task ---------------------------------------------------------------------------


def tops_of(parent: np.ndarray) -> np.ndarray:
    """The top of each node's component, by pointer doubling; parent is -1 at tops."""
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    while True:
        further = up[up]
        if np.array_equal(further, up):
            return up
        up = further


def decompose(parent: np.ndarray, weight: np.ndarray, values: np.ndarray, added: np.ndarray) -> np.ndarray:
    """Subtree totals of ``values`` (k x n) plus ``added``, for a forest of parent indices (-1 at tops).

    ``weight`` is that of each node's subtree, all nodes weighing 1 at least. All components are split at once.
    """
    parent, weight, out = parent.copy(), weight.copy(), added.copy()
    live, top = np.ones(len(parent), bool), tops_of(parent)
    while live.any():
        at = np.flatnonzero(live)
        chain = at[2 * weight[at] > weight[top[at]]]
        chain = chain[np.lexsort((weight[chain], top[chain]))]
        first = np.concatenate(([True], np.diff(top[chain]) != 0))
        centroid = chain[first]  # the lightest of each chain
        of = centroid[np.cumsum(first) - 1]
        removed = np.zeros(len(parent), bool)
        removed[centroid] = True
        below = (parent >= 0) & removed[parent]
        pieces = tops_of(np.where(below, -1, parent))
        total = np.zeros_like(values)
        total[:, centroid] = values[:, centroid]
        under = at[below[pieces[at]]]
        for k in range(len(values)):
            np.add.at(total[k], parent[pieces[under]], values[k, under])
        out[:, centroid] += total[:, centroid]
        path, its = chain[~first], of[~first]
        out[:, path] += total[:, its]
        weight[path] -= weight[its]
        parent, top = np.where(below, -1, parent), pieces
        live[centroid] = False
    return out


_STATE = "conv_id long, depth long, parent long, top_conv long, top_depth long, weight long, leaf long, saved long, add_leaf long, add_saved long"
_TOTALS = "conv_id long, depth long, n_leaves long, saved_tokens long"


def _finish(rows: pa.Table) -> pa.RecordBatch:
    c = {name: rows.column(name).to_numpy() for name in rows.column_names}
    place = {key: k for k, key in enumerate(zip(c["conv_id"].tolist(), c["depth"].tolist(), strict=True))}
    is_top = (c["conv_id"] == c["top_conv"]) & (c["depth"] == c["top_depth"])
    parent = np.fromiter((-1 if top else place[p, d - 1] for top, p, d in zip(is_top.tolist(), c["parent"].tolist(), c["depth"].tolist(), strict=True)), np.int64, len(is_top))
    totals = decompose(parent, c["weight"], np.stack((c["leaf"], c["saved"])), np.stack((c["add_leaf"], c["add_saved"])))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (c["conv_id"], c["depth"], *totals)], names=["conv_id", "depth", "n_leaves", "saved_tokens"])


def _finish_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components stand together, tops first; those that have ended are decomposed, the last one waits for its rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        a, b = rows.column("top_conv").to_numpy(), rows.column("top_depth").to_numpy()
        change = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield _finish(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield _finish(pa.Table.from_batches(held))


# --- the decomposition of large components -----------------------------------------------------------------------


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("top_conv", "top_depth").agg(F.max("weight").alias("total"), F.count("*").alias("size"))


def _split(rows: DataFrame, large: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished centroids, remaining rows under their new tops) of all large components."""
    top = ["top_conv", "top_depth"]
    known = rows.join(large.select(*top, "total"), top)
    centroids = materialize(known.filter("2 * weight > total").groupBy(*top).agg(
        F.min_by(F.struct("conv_id", "depth", "weight"), "weight").alias("c")).select(
        *top, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
    known = known.join(centroids, top).withColumn("chain", F.expr("2 * weight > total"))
    steps = lookup.select(F.col("conv_id").alias("s_conv"), F.col("depth").alias("s_depth"), "owner", F.col("parent").alias("s_parent"))
    # the node one step below the centroid's depth on the way to this one tells whether it hangs under the centroid, and by which child
    deep = known.filter("depth > c_depth").join(steps, (F.col("conv_id") == F.col("s_conv")) & (F.col("c_depth") + 1 == F.col("s_depth")))
    columns = [*known.columns, F.expr("CASE WHEN s_parent = c_conv THEN owner END").alias("child")]
    marked = materialize(deep.select(*columns).union(known.filter("depth <= c_depth").select(*known.columns, F.lit(None).cast("long").alias("child"))), "marked")
    is_centroid = F.expr("conv_id = c_conv AND depth = c_depth")
    part = F.col("child").isNotNull() | is_centroid
    totals = materialize(marked.filter(part).groupBy(*top).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved")), "totals")
    chain = marked.filter("chain").join(totals, top).withColumns({
        "add_leaf": F.expr("add_leaf + t_leaf"), "add_saved": F.expr("add_saved + t_saved")})
    done = chain.filter(is_centroid).select(*NODE, F.col("add_leaf").alias("n_leaves"), F.col("add_saved").alias("saved_tokens"))
    above = chain.filter(~is_centroid).withColumn("weight", F.expr("weight - c_weight")).select(*rows.columns)
    rest = marked.filter("NOT chain").withColumns({
        "top_conv": F.coalesce("child", "top_conv"), "top_depth": F.expr("CASE WHEN child IS NULL THEN top_depth ELSE c_depth + 1 END")}).select(*rows.columns)
    return materialize(done, "done"), materialize(above.union(rest), "pieces")


def rollup(forest: DataFrame, lookup: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: subtree totals of leaf and saved over rows conv_id, depth, parent, weight, leaf, saved."""
    top = ["top_conv", "top_depth"]
    root = forest.filter("parent IS NULL").first()
    if root is None:
        return forest.sparkSession.createDataFrame([], _TOTALS)
    whole = lambda x: F.lit(x).cast("long")
    rows = forest.select(*NODE, "parent", whole(root["conv_id"]).alias("top_conv"), whole(root["depth"]).alias("top_depth"), "weight", "leaf", "saved",
                         whole(0).alias("add_leaf"), whole(0).alias("add_saved"))
    rows = materialize(rows, "forest")  # else the one top is a constant, and joins on it have no key
    finished, small = [], []
    while True:
        large = materialize(_sizes(rows).filter(F.col("size") > local), "large")
        small.append(rows.join(large, top, "left_anti"))
        if large.isEmpty():
            break
        done, rows = _split(rows.join(large, top, "left_semi"), large, lookup)
        finished.append(done)
    ready = reduce(DataFrame.union, small).repartition(*top).sortWithinPartitions(*top, "depth")
    return reduce(DataFrame.union, finished, ready.mapInArrow(_finish_all, _TOTALS))


# --- digests of the members that end at a node -----------------------------------------------------------------


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node, fed piece by piece; rows come by node and piece."""
    node, digest = None, None
    row = lambda: pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": digest.hexdigest()}])
    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv, depth) != node:
                if node:
                    yield row()
                node, digest = (conv, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node:
        yield row()


def ends_of(lookup: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of every node at which conversations end.

    SHA-256 runs over a list from its start, so one task has to digest a node's list; it gets it in pieces and holds one batch of them.
    """
    ends = materialize(lookup.filter("depth = len").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("id")), "ends")
    listed = lambda rows: F.array_join(F.sort_array(F.collect_list(rows)), ",")
    many = materialize(ends.groupBy(*NODE).agg(F.count("*").alias("n")).filter(F.col("n") > LISTED).select(*NODE), "many")
    short = ends.join(many, NODE, "left_anti").groupBy(*NODE).agg(F.sha2(listed("id"), 256).alias("ends_sha256"))
    if many.isEmpty():
        return short
    numbered = rank_rows(materialize(ends.join(many, NODE, "left_semi"), "long"), NODE, ["id"], "n")
    pieces = numbered.groupBy(*NODE, F.expr(f"(n - 1) div {PIECE}").alias("piece")).agg(listed("id").alias("ids"))
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return short.union(ordered.mapInArrow(_digest, "conv_id long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, lookup = nodes_of(rebuilt_paths(ordered_turns(conversations)))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = materialize(nodes.withColumns({"leaf": F.expr("CASE WHEN n_children = 0 THEN 1L ELSE 0L END"), "saved": F.expr("(n_convs - 1) * chars")}), "nodes")
    totals = rollup(nodes.select(*NODE, "parent", "weight", "leaf", "saved"), lookup, local)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(totals, NODE).join(ends_of(lookup), NODE, "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))

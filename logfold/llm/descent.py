"""Near-duplicate vectors by NN-descent.

1. Equal vectors of a label become one with a number of copies.
2. A label of up to ``LIST_MOST`` different vectors fits into one list and is one block. Steps 3 to 6 are for all others.
3. A first graph: vectors of a label that share the signs of random projections, as many as its size needs, are
   compared in small blocks, and each keeps a list of its nearest. Only neighbours from a cosine of ``FLOOR`` are kept,
   since others lead nowhere near a duplicate.
4. Descent: the neighbours of a vector are compared with each other, which joins every vector with the neighbours of
   its neighbours; lists keep the best. It ends when lists no longer change. A list that is full of links is saturated:
   it becomes ``GROW`` times as long and the descent goes on.
5. Every comparison that gives a link counts, whether a list has room for it or not: a block returns ties, the fewest
   pairs that connect what its links connect.
6. Audit. A label is settled when, by theory, a pair at ``LINK`` has shared a cell with a probability of ``TARGET``, and
   a trial agrees. The trial takes about ``AUDIT`` vectors of the label, half of them by a hash of all and half by a hash
   of those with a neighbour in their list, and compares them with all others: for those of every size class (by powers
   of two of their links) ``TARGET`` of the links must lie within one component. Where none of them has a link, planted
   pairs are the trial: vectors turned by the angle of ``LINK``, of which ``TARGET`` must have shared a block with
   what they were turned from. Other labels get more projections. Only a label that is not settled after ``ROUNDS`` is
   compared whole, in blocks.
7. Ties make components. Within a component all pairs are compared in blocks, which gives the exact number of links;
   only numbers leave a block.

Cosines are taken in double precision, of the vectors as given: float vectors travel as float, all others as double.
Vectors that are null, empty, zero, or hold null or non-finite components, or have no label, link with nothing; so do
vectors of different length. A component's id is its smallest vec_id. Rows that share a vec_id are one row each, with
equal results if their vectors are equal; a null vec_id links with nothing. An empty table gives an empty result.
Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logfold.llm.graph import components
from logfold.session import materialize

LINK, FLOOR = 0.98, 0.8
#: Length of a list, factor when it is saturated, and greatest length.
LIST, GROW, LIST_MOST = 16, 4, 64
#: Projections (tables of sign bits) that a round adds, rows that a block of the first graph has about, rows of an exact block.
TABLES, CELL, EXACT = 6, 64, 512
#: Rows of a block of the audit and of a label that is compared whole.
BLOCK = 2048
#: Vectors (and planted pairs) that are audited in a label, share of links that must be found, rounds before it is compared whole.
AUDIT, TARGET, ROUNDS = 512, 0.995, 6
#: Signs of a table at most.
MOST_BITS = 32
#: Descent steps of a round at most, and the share of list entries that may still change at its end.
STEPS, STILL = 6, 0.001


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled first, so that squares of very large or small components stay finite
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _edges(ids: np.ndarray, near: np.ndarray, most: np.ndarray | int, least: np.ndarray | float) -> pa.Table:
    """For each row of a square of cosines, its greatest entries off the diagonal, above ``least``."""
    np.fill_diagonal(near, -2)
    count = min(int(np.max(most)), len(ids) - 1)
    best = np.argpartition(-near, count - 1, axis=1)[:, :count] if count < len(ids) - 1 else np.argsort(-near, axis=1)[:, :count]
    value = np.take_along_axis(near, best, axis=1)
    keep = value >= (least[:, None] if isinstance(least, np.ndarray) else least)
    rows = np.repeat(np.arange(len(ids)), count).reshape(len(ids), count)[keep]
    return pa.table({"a": ids[rows], "b": ids[best[keep]], "near": value[keep]})


_EDGE = "a long, b long, near double, tie boolean"
_NO_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.float64()), ("tie", pa.bool_())])


def _hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable place of every place, with links a, b added to earlier ones."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        differ = low != high
        if not differ.any():
            return root
        a, b = a[differ], b[differ]
        root = root.copy()
        np.minimum.at(root, high[differ], low[differ])
        while (root[root] != root).any():
            root = root[root]


def _edges_and_ties(ids: np.ndarray, near: np.ndarray, most: np.ndarray | int, least: np.ndarray | float) -> pa.Table:
    """The edges for lists, and pairs that connect whatever the links of the square connect."""
    root = _hooked(np.arange(len(ids)), *np.nonzero(near >= LINK))
    tied = np.flatnonzero(root != np.arange(len(ids)))
    edges = _edges(ids, near, most, least)
    edges = edges.append_column("tie", pa.array(np.zeros(len(edges), bool)))
    return pa.concat_tables([edges, pa.table({"a": ids[tied], "b": ids[root[tied]], "near": np.ones(len(tied)), "tie": np.ones(len(tied), bool)})])


def _bits(size: Column) -> Column:
    """Signs that put about ``CELL`` of so many vectors into a cell."""
    return F.least(F.greatest(F.ceil(F.log2(size / CELL)), F.lit(1)), F.lit(MOST_BITS)).cast("int")


def _chosen(size: Column, count: int, seed: int) -> Column:
    """About ``count`` of so many vectors, by a hash."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) * size < count * (1 << 30)


def _turned(x: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors at a cosine of ``LINK`` to the given ones, in a direction that depends on id and seed alone."""
    away = np.stack([np.random.default_rng((seed, abs(int(i)))).normal(size=x.shape[1]) for i in ids])
    away -= (away * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((away * away).sum(axis=1, keepdims=True))
    return LINK * x + math.sqrt(1 - LINK * LINK) * away / np.where(length > 0, length, 1)


def projected(vectors: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Edges and ties between vectors that share the signs of random projections, in ``TABLES`` tables.

    Also grp, id and met: whether a vector shared a block with the one that was planted beside it, for about ``AUDIT``
    vectors of a label. Planted vectors are compared with nothing else.
    """
    value = _value_type(vectors)
    schema = pa.schema([("id", pa.int64()), ("grp", pa.string()), ("cell", pa.string()), ("planted", pa.bool_()), ("x", pa.list_(value))])

    def signs(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for dim, rows in _by_length(batch):
                x = unit(rows.column("x"))
                bits = rows.column("bits").to_numpy()
                most = int(bits.max())
                planes = np.random.default_rng(seed * 1009 + dim).normal(size=(dim, TABLES, MOST_BITS))[:, :, :most]

                def codes(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
                    # a smaller label uses the first of the signs
                    sign = ((x @ planes.reshape(dim, -1)) > 0).reshape(len(x), TABLES, most) & (np.arange(most) < bits[:, None])[:, None]
                    return sign @ (1 << np.arange(most, dtype=np.int64))

                probe = np.flatnonzero(rows.column("probe").to_numpy(zero_copy_only=False))
                own, names, ids = codes(x, bits), rows.column("grp").to_pylist(), rows.column("id")
                beside = codes(_turned(x[probe], ids.to_numpy()[probe], seed), bits[probe]) if len(probe) and dim > 1 else own[probe]
                some = pa.array(probe)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([
                        ids, rows.column("grp"), pa.array([f"{g}:{t}:{c}" for g, c in zip(names, own[:, t], strict=True)]),
                        pa.array(np.zeros(len(ids), bool)), rows.column("x").cast(pa.list_(value))], schema=schema)
                    if len(probe):
                        yield pa.RecordBatch.from_arrays([
                            ids.take(some), rows.column("grp").take(some),
                            pa.array([f"{names[k]}:{t}:{c}" for k, c in zip(probe, beside[:, t], strict=True)]),
                            pa.array(np.ones(len(probe), bool)), pa.array([None] * len(probe), pa.list_(value))], schema=schema)

    def compare(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return _NO_EDGE.empty_table()
        x = unit(table.column("x"))
        return _edges_and_ties(table.column("id").to_numpy(), x @ x.T, LIST, FLOOR)

    asked = vectors.select("id", "grp", "x", _bits(F.col("group_size")).alias("bits"), _chosen(F.col("group_size"), AUDIT, 12).alias("probe"))
    both = materialize(asked.mapInArrow(signs, f"id long, grp string, cell string, planted boolean, {_x_type(vectors)}"), "cells")
    cells = both.filter("NOT planted")
    size = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a crowded cell is dealt into blocks at random, another deal in every table
    block = lambda salt: F.pmod(F.xxhash64("id", "cell", F.lit(salt)), F.ceil(F.col("n") / (4 * CELL)).cast("long"))
    edges = (cells.join(size, "cell").withColumn("block", block(0)).select("cell", "block", "id", "x")
             .groupBy("cell", "block").applyInArrow(compare, _EDGE))
    # where a planted vector lies in a cell with its own, both have the same id there
    probes = both.filter("planted").select("id", "grp", "cell")
    sized = probes.join(size, "cell", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("beside", block(1)).withColumn("block", block(0))
    beside = sized.join(cells.select("id", "grp", "cell", F.lit(True).alias("here")), ["id", "grp", "cell"], "left")
    met = beside.groupBy("grp", "id").agg(F.max(F.coalesce(F.col("here") & (F.col("beside") == F.col("block")), F.lit(False))).alias("met"))
    return edges, met


def _value_type(vectors: DataFrame) -> pa.DataType:
    return pa.float32() if vectors.schema["x"].dataType.elementType.typeName() == "float" else pa.float64()


def _x_type(vectors: DataFrame) -> str:
    return f"x {vectors.schema['x'].dataType.simpleString()}"


def _by_length(batch: pa.RecordBatch):  # noqa: ANN202
    import pyarrow.compute as pc

    length = pc.list_value_length(batch.column("x"))
    for dim in pc.unique(length).to_pylist():
        yield dim, batch.filter(pc.equal(length, dim))


def merged(old: DataFrame | None, new: DataFrame, room: DataFrame | None) -> DataFrame:
    """The best of both for every vector; fresh marks what the old lists did not have."""
    both = new.select("a", "b", "near", F.lit(1).alias("fresh"))
    if old is not None:
        both = both.union(old.select("a", "b", "near", F.lit(0).alias("fresh")))
    both = both.groupBy("a", "b").agg(F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), "b"))
    if room is None:
        return both.withColumn("rank", rank).filter(F.col("rank") <= LIST).withColumn("room", F.lit(LIST))
    ranked = both.withColumn("rank", rank).join(room, "a", "left").withColumn("room", F.coalesce("room", F.lit(LIST)))
    return ranked.filter(F.col("rank") <= F.col("room"))


def neighbours_of_neighbours(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges between neighbours of one vector that may improve a list, and ties between them."""
    last = lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("worst"), F.max("room").alias("room"))
    least = F.when(F.col("n") >= F.col("room"), F.col("worst")).otherwise(FLOOR)
    ends = vectors.select("id", "x").join(last.select(F.col("a").alias("id"), least.alias("least"), "room"), "id")
    # lists with the vectors that list this one, again cut to the best; a vector is in its own group
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "near", "fresh")
    both = lists.select("a", "b", "near", "fresh").union(back).groupBy("a", "b").agg(F.max("near").alias("near"), F.max("fresh").alias("fresh"))
    both = both.join(last.select("a", "room"), "a", "left").withColumn("room", F.coalesce("room", F.lit(LIST)))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("fresh"), F.xxhash64("a", "b")))
    group = both.withColumn("rank", rank).filter(F.col("rank") <= 2 * F.col("room"))
    live = group.groupBy("a").agg(F.max("fresh").alias("live")).filter("live = 1").select("a")
    group = group.join(live, "a").select("a", "b").union(live.select("a", F.col("a").alias("b")))

    def compare(table: pa.Table) -> pa.Table:
        if table.num_rows < 3:
            return _NO_EDGE.empty_table()
        x = unit(table.column("x"))
        return _edges_and_ties(table.column("id").to_numpy(), x @ x.T, table.column("room").to_numpy(), table.column("least").to_numpy())

    return group.withColumnRenamed("b", "id").join(ends, "id").select("a", "id", "x", "room", "least").groupBy("a").applyInArrow(compare, _EDGE)


def descend(lists: DataFrame, vectors: DataFrame, room: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Refine the lists until they hardly change; the lists and the ties that were met."""
    ties = []
    for _ in range(STEPS):
        new = materialize(neighbours_of_neighbours(lists, vectors), "edges")
        ties.append(new.filter("tie").select("a", "b"))
        lists = materialize(merged(lists, new.filter("NOT tie"), room), "lists")
        change = lists.agg(F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("n")).head()
        if (change.fresh or 0) <= STILL * change.n:
            break
    return lists, reduce(DataFrame.union, ties)


def graph(vectors: DataFrame, old: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbour lists and ties (first graph, descent, longer lists where they are full of links), and the planted pairs."""
    edges, met = projected(vectors, seed)
    new = materialize(edges, "edges")
    lists = materialize(merged(old, new.filter("NOT tie"), None), "lists")
    lists, ties = descend(lists, vectors, None)
    ties = ties.union(new.filter("tie").select("a", "b"))
    length = LIST
    while length < LIST_MOST:
        full = lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("worst")).filter((F.col("n") >= length) & (F.col("worst") >= LINK))
        room = materialize(full.select("a", F.lit(length * GROW).alias("room")), "room")
        if room.isEmpty():
            break
        length *= GROW
        # all entries of a saturated list count as new once, for its longer successor
        lists = lists.drop("room").join(room, "a", "left").withColumn("fresh", F.when(F.col("room").isNotNull(), 1).otherwise(F.col("fresh")))
        lists = materialize(lists.withColumn("room", F.coalesce("room", F.lit(LIST))), "lists")
        lists, more = descend(lists, vectors, room)
        ties = ties.union(more)
    return lists, ties, met


def with_component(vectors: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return vectors.withColumn("component", F.col("id"))
    return vectors.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def whole_ties(vectors: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Ties a, b between components: all pairs of vectors of a label are compared, in pairs of blocks."""
    own = with_component(vectors, labels).withColumn("blocks", F.ceil(F.col("group_size") / BLOCK).cast("long"))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    pairs = own.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "grp", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), (F.col("block") <= F.col("k")).alias("low"),
        (F.col("block") >= F.col("k")).alias("high"), "x", "component")

    def compare(table: pa.Table) -> pa.Table:
        names, code = np.unique(table.column("component").to_numpy(), return_inverse=True)
        left, right = (np.flatnonzero(table.column(k).to_numpy()) for k in ("low", "high"))
        x, root = unit(table.column("x")), np.arange(len(names))
        for begin in range(0, len(left), 256):
            some = left[begin:begin + 256]
            rows, columns = np.nonzero(x[some] @ x[right].T >= LINK)
            root = _hooked(root, code[some[rows]], code[right[columns]])
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[tied], "b": names[root[tied]]})

    return materialize(pairs.groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long"), "ties")


def audit(vectors: DataFrame, labels: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """grp and recall: the least share, over size classes, of the links of some vectors that lie within a component.

    The vectors, half of them from all and half from those with a neighbour in ``lists``, are compared with all others of
    their label; a label whose audited vectors have no link has no row.
    """
    parts = F.ceil(F.col("group_size") / BLOCK).cast("long")
    rows = with_component(vectors, labels).select("grp", "id", "x", "component", "group_size", parts.alias("parts"))
    chosen = rows.filter(_chosen(F.col("group_size"), AUDIT if lists is None else AUDIT // 2, 11)).select("grp", "id")
    if lists is not None:
        near = rows.select("grp", "id").join(lists.select(F.col("a").alias("id")).distinct(), "id")
        size = near.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        chosen = chosen.union(near.join(size, "grp").filter(_chosen(F.col("n"), AUDIT // 2, 13)).select("grp", "id")).distinct()
    asked = rows.join(chosen, ["grp", "id"], "left_semi")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("asked", F.lit(True))
    others = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("asked", F.lit(False))
    dealt = asked.select("grp", "part", "asked", "id", "x", "component").union(others.select("grp", "part", "asked", "id", "x", "component"))

    def count(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy()
        ids, component, x = table.column("id").to_numpy(), table.column("component").to_numpy(), unit(table.column("x"))
        linked = (x[asked] @ x[~asked].T >= LINK) & (ids[asked][:, None] != ids[~asked])
        found = linked & (component[asked][:, None] == component[~asked])
        return pa.table({"grp": table.column("grp").filter(pa.array(asked)), "id": ids[asked], "links": linked.sum(axis=1), "found": found.sum(axis=1)})

    each = (dealt.groupBy("grp", "part").applyInArrow(count, "grp string, id long, links long, found long")
            .groupBy("grp", "id").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).filter("links > 0"))
    share = (F.sum("found") / F.sum("links")).alias("share")
    return each.groupBy("grp", F.length(F.bin("links")).alias("class")).agg(share).groupBy("grp").agg(F.min("share").alias("recall"))


def rounds_needed(size: Column) -> Column:
    """Rounds after which a pair at ``LINK`` has shared a cell with a probability of ``TARGET``."""
    same = F.pow(F.lit(1 - math.acos(LINK) / math.pi), _bits(size))
    return F.ceil(math.log(1 - TARGET) / F.log(1 - same) / TABLES).cast("int")


def connected(vectors: DataFrame) -> tuple[DataFrame, float]:
    """node and component of all that has links, and the least recall of a label."""
    labels = components(whole_ties(vectors.filter(F.col("group_size") <= LIST_MOST), None))
    large = vectors.filter(F.col("group_size") > LIST_MOST)
    left = materialize(large.groupBy("grp").agg(rounds_needed(F.max("group_size")).alias("rounds")), "left")
    lists, planted, recall = None, None, 1.0
    joined = lambda ties: components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(ties))
    for seed in range(1, ROUNDS + 1):
        if left.isEmpty():
            return labels, recall
        own = materialize(large.join(left, "grp", "left_semi"), "own")
        lists, ties, met = graph(own, lists and lists.join(own.select(F.col("id").alias("a")), "a", "left_semi"), seed)
        labels = joined(ties)
        planted = materialize((planted.union(met) if planted else met).groupBy("grp", "id").agg(F.max("met").alias("met")), "planted")
        trial = planted.groupBy("grp").agg(F.avg(F.col("met").cast("double")).alias("trial"))
        seen = left.join(audit(own, labels, lists), "grp", "left").join(trial, "grp", "left")
        seen = seen.withColumn("recall", F.coalesce("recall", "trial"))
        settled = materialize(seen.filter((F.col("rounds") <= seed) & (F.col("recall") >= TARGET)).select("grp", "recall"), "settled")
        least = settled.agg(F.min("recall")).head()[0]
        recall = recall if least is None else min(recall, least)
        left = materialize(left.join(settled, "grp", "left_anti"), "left")
    if not left.isEmpty():
        labels = joined(whole_ties(large.join(left, "grp", "left_semi"), labels))
    return labels, recall


def exact_links(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """id and its number of links to other vectors of its component, copies included."""
    members = vectors.join(labels.withColumnRenamed("node", "id"), "id").select("id", "x", "copies", "component")
    size = labels.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / EXACT).cast("long").alias("blocks"))
    own = members.join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    # every pair of blocks meets once, with the rows of both
    pairs = own.withColumn("k", other).select(
        "component", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), (F.col("block") <= F.col("k")).alias("low"),
        (F.col("block") >= F.col("k")).alias("high"), "id", "x", "copies")

    def count(table: pa.Table) -> pa.Table:
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        low, high = (table.column(k).to_numpy() for k in ("low", "high"))
        x = unit(table.column("x"))
        linked = x[low] @ x[high].T >= LINK
        if low.all() and high.all():
            np.fill_diagonal(linked, False)
            return pa.table({"id": ids, "links": linked @ copies})
        return pa.table({"id": np.concatenate((ids[low], ids[high])), "links": np.concatenate((linked @ copies[high], copies[low] @ linked))})

    return pairs.groupBy("component", "i", "j").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall; one row per vector."""
    given = table.schema["embedding"].dataType.elementType.typeName()
    rows = table.select("vec_id", "label", F.col("embedding").cast("array<float>" if given == "float" else "array<double>").alias("x"))
    good = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(usable(F.col("x")))
    good = good.withColumn("grp", F.concat_ws(":", "label", F.size("x")))
    same = good.groupBy("grp", "x").agg(F.min("vec_id").cast("long").alias("id"), F.count(F.lit(1)).alias("copies"))
    count = same.groupBy("grp").agg(F.count(F.lit(1)).alias("group_size"))
    vectors = materialize(same.join(count, "grp"), "vectors")
    labels, recall = connected(vectors)
    links = exact_links(vectors, labels)
    found = (vectors.select("grp", "x", "id", "copies").join(labels.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
             .select("grp", "x", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = good.join(found, ["grp", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x"))))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("recall", F.lit(recall))

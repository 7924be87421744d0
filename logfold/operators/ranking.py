"""Ordered operators that stay parallel when one group holds much of the table.

A plain window sorts each group in one task. Here a group above ``hot_rows`` is spread over
range partitions first, numbered inside each, and put together with per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logfold.session import materialize

HOT_ROWS = 4_000_000
HOT_KEYS = 100_000
CHUNK_ROWS = 1_000_000


def join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL, as it does in grouping."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition &= F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``join_back`` with a side that should be small: written first, so its true size decides.

    Below the session's broadcast limit the left side is not shuffled at all, which matters
    where a few keys split a large table; above it both sides are.
    """
    return join_back(left, materialize(right, "small"), keys, how)


def _hashed(keys: Sequence[str]) -> list:
    """Keys led by their hash: sorting long strings with common heads is then one comparison."""
    return [F.xxhash64(*keys).alias("_key_hash"), *keys] if keys else []


def _group_window(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*([F.xxhash64(*keys)] if keys else []), *keys)


def pick_rows(df: DataFrame, key: str, order: Sequence[str], last: bool = True,
              count: str | None = None) -> DataFrame:
    """The last (or first) row of each key by ``order``, and the number of rows if asked for.

    Rows of a key are combined before the shuffle. A struct in the buffer means a sort-based
    aggregate, so the key's hash leads the sort.
    """
    payload = F.struct(*[c for c in df.columns if c != key])
    pick = F.max_by if last else F.min_by
    aggregates = [pick(payload, F.struct(*order)).alias("_row")]
    if count:
        aggregates.append(F.count("*").alias(count))
    picked = df.groupBy(*_hashed([key])).agg(*aggregates)
    return picked.select(key, "_row.*", *([count] if count else []))


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n",
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the rows of each group 1, 2, ... by ``order``, which must be a total order.

    One narrow counting pass decides the plan. Without hot groups this is one window, one
    shuffle. Otherwise the largest groups, ``HOT_KEYS`` of them at most, take the range path
    and the rest keep the window; beyond that many, what is left holds no more than a
    ``HOT_KEYS``-th of the table each. No keys means one group, the whole table, which takes the range path
    at every size.
    """
    keys, order = list(keys), list(order)
    if not keys:
        return _rank_by_range(df, keys, order, out, max(2, -(-2 * df.count() // hot_rows)))
    routing = F.xxhash64(*keys)
    hot = (df.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > hot_rows)
           .select(routing.alias("_hash"), "_size").orderBy(F.desc("_size")).limit(HOT_KEYS).collect())
    window = _group_window(keys).orderBy(*order)
    if not hot:
        return df.withColumn(out, F.row_number().over(window).cast("long"))
    chunks = max(2, -(-2 * sum(row["_size"] for row in hot) // hot_rows))

    # A cold group that shares a hot one's hash merely takes the range path too.
    hashes = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in {row["_hash"] for row in hot}], "_hash long"))
    routed = df.withColumn("_hash", routing)
    cold = routed.join(hashes, "_hash", "left_anti").drop("_hash")
    spread = routed.join(hashes, "_hash", "left_semi").drop("_hash")
    plain = cold.withColumn(out, F.row_number().over(window).cast("long"))
    return plain.unionByName(_rank_by_range(spread, keys, order, out, chunks))


def _rank_by_range(df: DataFrame, keys: list[str], order: list[str], out: str, chunks: int) -> DataFrame:
    """Sample-balanced range partitions; their numbers are frozen by writing them out."""
    ranged = materialize(
        df.repartitionByRange(chunks, *keys, *order).withColumn("_chunk", F.spark_partition_id()),
        "ranges")
    sizes = ranged.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    local = _group_window(["_chunk", *keys]).orderBy(*order)
    numbered = ranged.withColumn(out, F.row_number().over(local).cast("long"))
    if not keys:
        # one number per partition, of hot_rows / 2 rows each: added up here, not by a window in one task
        counted = sorted(sizes.collect())
        before = list(accumulate((size for _, size in counted), initial=0))
        offsets = df.sparkSession.createDataFrame(
            [(chunk, offset) for (chunk, _), offset in zip(counted, before, strict=False)], "_chunk int, _offset long")
        return _offset(numbered, offsets, ["_chunk"], out)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first group of a partition can have rows in an earlier one: at most one row each.
    offsets = (sizes.withColumn("_offset", F.sum("_size").over(earlier))
               .where(F.col("_offset").isNotNull()).drop("_size"))
    return _offset(numbered, offsets, ["_chunk", *keys], out)


def _offset(numbered: DataFrame, offsets: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Numbers within a partition raised by what lies before it."""
    joined = join_small(numbered, offsets, keys, "left")
    joined = joined.withColumn(out, F.col(out) + F.coalesce(F.col("_offset"), F.lit(0)))
    return joined.drop("_chunk", "_offset")


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int,
                    after: int, chunk_rows: int = CHUNK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cut each ordered group into chunks that overlap by a few rows.

    Adds ``_pos`` (1, 2, ...), ``_chunk`` and ``_core``. Windows over (keys, _chunk) ordered by
    ``_pos`` see ``before`` rows back and ``after`` rows ahead of every core row; keep the rows
    where ``_core`` holds afterwards. No chunk exceeds chunk_rows + before + after rows.
    """
    ranked = rank_rows(df, keys, order, "_pos", hot_rows)
    at = F.col("_pos") - 1
    first = F.greatest(F.lit(0), F.floor((at - after) / chunk_rows))
    last = F.floor((at + before) / chunk_rows)
    spread = ranked.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return spread.withColumn("_core", F.col("_chunk") == F.floor(at / chunk_rows))


def chunk_window(keys: Sequence[str], start: int | None = None, end: int | None = None) -> WindowSpec:
    """The window that goes with ``with_neighbours``, with a row frame if one is given."""
    window = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    return window if start is None else window.rowsBetween(start, end)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str],
                 chunk_rows: int = CHUNK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running totals per group: inside chunks, plus the totals of all earlier chunks.

    ``sums`` maps output names to the columns to add up.
    """
    keys = list(keys)
    ranked = (rank_rows(df, keys, order, "_pos", hot_rows)
              .withColumn("_chunk", F.floor((F.col("_pos") - 1) / chunk_rows)))
    totals = ranked.groupBy(*keys, "_chunk").agg(
        *[F.sum(source).alias(f"_total_{name}") for name, source in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}")
        for name in sums])
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = ranked.withColumns({f"_local_{name}": F.sum(source).over(inside)
                                for name, source in sums.items()})
    joined = join_small(local, bases, [*keys, "_chunk"])
    return joined.select(*[c for c in df.columns if c not in sums], *[
        (F.col(f"_local_{name}") + F.col(f"_base_{name}")).alias(name) for name in sums])


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median",
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median per group; NULLs do not count.

    Equal values are counted before they are shuffled, so a value that most rows share is one
    row. The middle lies where the running count of the distinct values reaches it.
    """
    keys = list(keys)
    times = materialize(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_times")), "times")
    sizes = times.groupBy(*keys).agg(F.sum("_times").alias("_size"))
    upto = running_sums(times.withColumn("_own", F.col("_times")), keys, [value], {"_upto": "_own"}, hot_rows=hot_rows)
    since = F.col("_upto") - F.col("_times")
    holds = lambda at: (at > since) & (at <= F.col("_upto"))
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    middle = join_small(upto, sizes, keys)
    return middle.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias(out))


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], fraction: float,
               slots: int = 4096, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per group the order values of the last record in its first ``fraction``.

    Only a sliver of the rows is ever sorted: a histogram over ``slots`` equal ranges of the
    first order column, which must be numeric, tells which slot holds the cut, and only the
    rows of that slot are ranked. A group whose share rounds down to nothing gets NULLs and
    ``has_cut`` false; the order values of a cut may be NULL themselves.
    """
    keys, order = list(keys), list(order)
    rows = df.select(*keys, *order)
    spans = rows.groupBy(*keys).agg(
        F.min(order[0]).alias("_lo"), F.max(order[0]).alias("_hi"), F.count("*").alias("_rows"))
    spans = materialize(
        spans.withColumn("_target", F.floor(F.lit(fraction) * F.col("_rows")).cast("long")), "spans")
    joined = join_back(rows, spans.drop("_rows"), keys)
    width = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1) / F.lit(float(slots)))
    slotted = joined.withColumn("_slot", F.floor((F.col(order[0]) - F.col("_lo")) / width))
    histogram = slotted.groupBy(*keys, "_target", "_slot").agg(F.count("*").alias("_size"))
    upto = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    wanted = materialize(
        histogram.withColumn("_upto", F.sum("_size").over(upto))
        .where((F.col("_upto") >= F.col("_target")) & (F.col("_upto") - F.col("_size") < F.col("_target")))
        .select(*keys, "_slot", (F.col("_target") - F.col("_upto") + F.col("_size")).alias("_left")), "slots")
    sliver = materialize(
        join_back(slotted, wanted, [*keys, "_slot"]).select(*rows.columns, "_left"), "sliver")
    found = rank_rows(sliver, keys, order, "_n", hot_rows).where(F.col("_n") == F.col("_left"))
    cuts = found.select(*keys, F.lit(True).alias("has_cut"), *[F.col(c).alias(f"cut_{c}") for c in order])
    return join_back(spans, cuts, keys, "left").select(
        *keys, F.col("_rows").alias("rows"), F.coalesce("has_cut", F.lit(False)).alias("has_cut"), *[f"cut_{c}" for c in order])

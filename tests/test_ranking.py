import random
import statistics

import pytest
from pyspark.sql import functions as F

from logfold.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one key is NULL, times tie."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randint(0, 40), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t long, id long"), rows


def expected_ranks(rows, keys=True):
    seen, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        group = k if keys else 0
        seen[group] = seen.get(group, 0) + 1
        out[i] = seen[group]
    return out


@pytest.mark.parametrize("hot_rows", [10 ** 6, 1000, 100, 7])
def test_rank_rows(skewed, hot_rows):
    df, rows = skewed
    got = R.rank_rows(df, ["k"], ["t", "id"], "n", hot_rows)
    assert got.columns == ["k", "t", "id", "n"]
    assert {r.id: r.n for r in got.collect()} == expected_ranks(rows)


@pytest.mark.parametrize("hot_rows", [10 ** 6, 100])
def test_rank_whole_table(skewed, hot_rows):
    df, rows = skewed
    got = R.rank_rows(df, [], ["t", "id"], "n", hot_rows)
    assert {r.id: r.n for r in got.collect()} == expected_ranks(rows, keys=False)


def test_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, t long")
    assert R.rank_rows(empty, ["k"], ["t"]).collect() == []
    assert R.rank_rows(empty, [], ["k", "t"]).collect() == []


@pytest.mark.parametrize("hot_rows", [10 ** 6, 100])
def test_no_table_is_ranked_in_one_task(skewed, hot_rows):
    plan = R.rank_rows(skewed[0], [], ["t", "id"], "n", hot_rows)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("chunk_rows,hot_rows", [(10 ** 6, 10 ** 6), (50, 300), (7, 100)])
def test_running_sums(skewed, chunk_rows, hot_rows):
    df, rows = skewed
    got = R.running_sums(df.withColumn("w", F.col("id") % 5), ["k"], ["t", "id"], {"s": "w", "c": "id"},
                         chunk_rows, hot_rows)
    sums, want = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        s, c = sums.get(k, (0, 0))
        sums[k] = (s + i % 5, c + i)
        want[i] = sums[k]
    got_pairs = sorted((r.k or "", r.s, r.c) for r in got.collect())
    ks = {i: k for k, _, i in rows}
    assert got_pairs == sorted((ks[i] or "", s, c) for i, (s, c) in want.items())


@pytest.mark.parametrize("chunk_rows", [10 ** 6, 50, 3, 1])
def test_neighbours_do_not_depend_on_chunks(skewed, chunk_rows):
    df, rows = skewed
    spread = R.with_neighbours(df, ["k"], ["t", "id"], 2, 3, chunk_rows, 500)
    around = spread.withColumn("s", F.sum("id").over(R.chunk_window(["k"], -2, 3))).where("_core")
    want = {}
    for key in {r[0] for r in rows}:
        ids = [i for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])) if k == key]
        for at, i in enumerate(ids):
            want[i] = sum(ids[max(0, at - 2):at + 4])
    assert {r.id: r.s for r in around.collect()} == want


@pytest.mark.parametrize("hot_rows", [10 ** 6, 100])
def test_group_median(skewed, hot_rows):
    df, rows = skewed
    got = {r.k: r.m for r in R.group_median(df, ["k"], "t", "m", hot_rows).collect()}
    assert got == {k: statistics.median(t for q, t, _ in rows if q == k) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("fraction,slots,hot_rows", [(0.5, 4096, 10 ** 6), (0.5, 4, 50), (0.9, 3, 20), (0.0, 8, 100),
                                                     (1.0, 8, 100)])
def test_cut_points(skewed, fraction, slots, hot_rows):
    df, rows = skewed
    got = {r.k: (r.rows, r.cut_t, r.cut_id)
           for r in R.cut_points(df, ["k"], ["t", "id"], fraction, slots, hot_rows).collect()}
    for key in {r[0] for r in rows}:
        group = sorted((t, i) for k, t, i in rows if k == key)
        at = int(fraction * len(group))
        assert got[key] == (len(group), *(group[at - 1] if at else (None, None)))


def test_pick_rows(skewed):
    df, rows = skewed
    last = {r.k: (r.t, r.id, r.c) for r in R.pick_rows(df, "k", ["t", "id"], count="c").collect()}
    first = {r.k: (r.t, r.id) for r in R.pick_rows(df, "k", ["t", "id"], last=False).collect()}
    for key in {r[0] for r in rows}:
        group = sorted((t, i) for k, t, i in rows if k == key)
        assert last[key] == (*group[-1], len(group))
        assert first[key] == group[0]


def test_median_of_equal_values_counts_them_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") < 19_999, 7.0).otherwise(9.0).alias("v"))
    assert R.group_median(df, ["k"], "v", "m", 1000).collect()[0].m == 7.0
    even = spark.createDataFrame([(1, 1), (1, 2), (2, None), (2, 5)], "k int, v int")
    assert {r.k: r.m for r in R.group_median(even, ["k"], "v", "m").collect()} == {1: 1.5, 2: 5.0}

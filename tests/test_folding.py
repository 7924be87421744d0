import random

import pytest
from pyspark.sql import functions as F

from logfold.operators import folding
from logfold.operators.amplify import amplify_duplicates, distinct_target
from logfold.plans import advice


@pytest.fixture(scope="module")
def records(spark):
    """Three hot signatures and some rare ones, in shuffled storage order."""
    rng = random.Random(7)
    rows = [(rng.choice(["x", "x", "x", "y", "z", f"rare{i % 90}"]), i // 3, i, f"text {i}") for i in range(1500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "sig string, t long, id long, message string"), rows


def simulate(rows, eps):
    """Strategy B record by record, as a single ordered pass."""
    state, emitted = {}, {}
    for sig, _, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        count, last = state.get(sig, (0, None))
        count += 1
        if last is None or count >= last * (1 + eps):
            emitted[i] = (sig, count)
            last = count
        state[sig] = (count, last)
    return emitted, state


@pytest.mark.parametrize("eps,hot_rows", [(0.02, 10 ** 6), (0.02, 100), (0.5, 10 ** 6), (0.0, 100)])
def test_emissions_equal_a_record_by_record_pass(records, eps, hot_rows):
    df, rows = records
    emitted, state = simulate(rows, eps)
    out = folding.edge_emissions(df, ["t", "id"], eps, hot_rows=hot_rows)
    assert {r.id: (r._agg_id, r["count"]) for r in out.collect()} == emitted
    final = {r.sig: (r.n, r.stored, r.forwarded) for r in folding.edge_counts(df, eps).collect()}
    assert final == {sig: (count, last, sum(1 for s, _ in emitted.values() if s == sig))
                     for sig, (count, last) in state.items()}


def test_running_counts_and_final_documents(records):
    df, rows = records
    running = folding.running_counts(df, ["t", "id"], hot_rows=100)
    assert running.count() == len(rows) and folding.keep_all(df).count() == len(rows)
    last = {}
    for r in sorted(running.collect(), key=lambda r: (r.t, r.id)):
        last[r.sig] = (r.id, r.message, r["count"])
    documents = folding.index_documents(df, ["t", "id"])
    assert {r.sig: (r.id, r.message, r["count"]) for r in documents.collect()} == last
    assert {r.sig: r["count"] for r in folding.signature_counts(df).collect()} == {s: v[2] for s, v in last.items()}


def test_first_and_distinct(records):
    df, rows = records
    firsts = {}
    for sig, t, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        firsts.setdefault(sig, i)
    assert {r.sig: r.id for r in folding.first_sightings(df, ["t", "id"]).collect()} == firsts
    assert folding.distinct_documents(df).count() == len(firsts)
    top = folding.hot_signatures(df, 3).collect()
    assert [r.sig for r in top][0] == "x" and len(top) == 3


@pytest.mark.parametrize("ratio,salt_rows,hot_rows", [(0.0, 10 ** 6, 10 ** 6), (0.6, 10 ** 6, 10 ** 6), (0.9, 3, 50),
                                                      (0.999, 2, 50)])
def test_amplify_keeps_its_promise(spark, ratio, salt_rows, hot_rows):
    base = spark.range(400).select((F.col("id") * 7).alias("doc"))
    out = amplify_duplicates(base, ["doc"], 400, ratio, salt_rows=salt_rows, hot_rows=hot_rows)
    rows = out.collect()
    assert sorted(r.position for r in rows) == list(range(400))
    assert len({r.doc for r in rows}) == distinct_target(400, ratio)
    assert len({r.timestamp for r in rows}) == 400
    with pytest.raises(ValueError, match="distinct"):
        amplify_duplicates(base.limit(3), ["doc"], 400, 0.5)
    plain = amplify_duplicates(base, ["doc"], 400, ratio).collect()
    assert {(r.position, r.doc) for r in plain} == {(r.position, r.doc) for r in rows}
    check = advice.validate_contract(out.select(F.col("doc").cast("string").alias("sig")), 400, ratio).first()
    assert check.distinct_ok and check.ce_ok and check.bound_ok and check.N == 400

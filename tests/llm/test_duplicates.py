"""Near-duplicate documents and vectors against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logfold.llm import bottomk, descent, graph


def joined(names, links):
    """Smallest reachable name of each."""
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in names}


def shingles(text, words=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[k:k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()


def brute(texts, words=4):
    sets = {k: shingles(x, words) for k, x in texts.items()}
    names = list(sets)
    links = [(a, b) for i, a in enumerate(names) for b in names[:i] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = joined(names, links)
    return {k: (len(sets[k]), label[k], label[k] == k) for k in names}


def found(out):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}


def mutated(draw, words, times):
    out = list(words)
    for _ in range(times):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10 ** 9)}"
    return " ".join(out)


def test_groups_equal_brute_force(spark):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    common = " ".join(draw.choices(vocabulary, k=30))
    for base in range(12):
        words = draw.choices(vocabulary, k=draw.choice([6, 12, 40, 90, 300]))
        for _ in range(draw.choice([1, 3, 25])):
            texts[len(texts)] = mutated(draw, words, draw.randrange(0, max(1, len(words) // 25) + 1))
    chain = draw.choices(vocabulary, k=120)
    for _ in range(60):  # every text is a copy of some earlier one with a few changes: similar to few of the others
        texts[len(texts)] = " ".join(chain)
        chain = mutated(draw, chain, draw.choice([1, 1, 2])).split()
    for k in range(40):  # a passage that many share, in short texts
        texts[len(texts)] = common + " " + " ".join(draw.choices(vocabulary, k=draw.choice([2, 5, 30])))
    for k in range(50):
        texts[len(texts)] = "  ".join(chain).upper()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for words in (4, 5):
        assert found(bottomk.near_duplicates(docs, words)) == brute(texts, words)


def test_small_texts_of_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(bottomk.near_duplicates(docs)) == brute({r.doc_id: r.text for r in docs.collect()})


def test_odd_documents(odd_docs, no_docs):
    out = bottomk.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out if r.doc_id not in (None, 7)}
    assert by[5].component_id == by[6].component_id == 5 and by[5].kept and not by[6].kept
    assert by[8].component_id == by[9].component_id == 7
    assert all(by[k].kept and by[k].n_shingles == 0 for k in (0, 1, 2))
    kept = bottomk.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 2 and ids.count(None) == 2 and 6 not in ids and {0, 1, 2, 3, 5, 10} <= set(ids)
    assert bottomk.near_duplicates(no_docs).collect() == [] and bottomk.keep_one(no_docs).collect() == []


def test_every_text_of_an_id_links_its_copies(spark):
    draw = random.Random(7)
    texts = [[f"t{k}w{j}" for j in range(60)] for k in range(3)]
    near = lambda own: " ".join([*own[:-1], f"new{draw.randrange(10 ** 9)}"])
    rows = [(10, " ".join(texts[0])), (10, " ".join(texts[1])), (10, " ".join(texts[2])), (11, near(texts[0])), (12, near(texts[1])), (13, near(texts[2])),
            (14, " ".join(f"other{j}" for j in range(60))), (9, near(texts[1]))]
    out = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(9, 9), (10, 9), (10, 9), (10, 9), (11, 9), (12, 9), (13, 9), (14, 14)]


def test_colliding_hashes_lose_no_pair(spark):
    # two hashes of both sets fall on the same 31 bits; the sets share exactly 80 %
    one, other = [5, 5 + (1 << 40), 7, 8, 9], [5, 5 + (1 << 40), 7, 8]
    rows = [(1, k, k, len(x), [1], x) for k, x in enumerate((one, other))]
    members = spark.createDataFrame(rows, "value long, node long, component long, n long, shared array<long>, items array<long>")
    sides = members.withColumn("fine", bottomk._fine("items")).withColumn("lost", bottomk._lost("fine")).select("node", "shared", "fine", "lost")
    chosen = members.filter("node = 0").selectExpr("value", "node", "0L AS part", "1L AS parts")
    assert [tuple(r) for r in bottomk._close_members(members, chosen, sides, 80).collect()] == [(0, 1)]


def test_sketch_is_the_lowest_hashes(spark):
    text = " ".join(f"w{k}" for k in range(300))
    own = next(bottomk.shingle_sets(pa.array([text]), 4))
    row = bottomk.sketches(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(own) == 297 and row.n == 297 and row.sketch == sorted(own.tolist())[:bottomk.KEPT]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(500, 501), (501, 500), (39, 100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == joined({x for p in links for x in p}, links)


def vectors(draw, base, times, angle):
    noise = draw.normal(size=(times, len(base)))
    noise -= np.outer(noise @ base, base)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    t = draw.uniform(0, angle, times)[:, None]
    return np.cos(t) * base + np.sin(t) * noise


def brute_vectors(rows):
    good = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows
            if v is not None and y is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for k, (a, v, y) in enumerate(good):
        links += [(a, b) for b, w, z in good[:k] if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98]
    label = joined([r[0] for r in rows], links)
    return {i: (sum(i in p for p in links), label[i], label[i] == i) for i, _, _ in rows}


def test_vector_links_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = []
    for label in range(3):
        for times, angle in [(1, 0), (3, 0.1), (40, 0.12), (90, 0.3), (250, 0.09)][: 3 + label]:
            base = draw.normal(size=24)
            rows += [(v, label) for v in vectors(draw, base / np.linalg.norm(base), times, angle).tolist()]
    rows += [(rows[5][0], 0)] * 30 + [(rows[5][0], 1), ([x * 1000 for x in rows[5][0]], 0), ([0.0] * 24, 0), ([float("nan")] * 24, 0), ([None] * 24, 0),
             ([float("inf")] + [0.0] * 23, 0), (None, 0), ([], 0), (rows[5][0], None), (rows[5][0][:5], 0)]
    rows = [(k, v, y) for k, (v, y) in enumerate(rows)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS grp").repartition(3)
    out = descent.near_vectors(table).collect()
    want = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == want
    assert descent.near_vectors(table.limit(0)).collect() == []


def crowded(draw):
    """Two groups of more vectors than a list holds whose only links to each other are their weakest, and pairs without other neighbours."""
    first, second, *others = np.linalg.qr(draw.normal(size=(64, 64)))[0]
    turn = np.arccos(0.985)
    second = np.cos(turn) * first + np.sin(turn) * second
    rows = [v for base in (first, second) for v in vectors(draw, base, 150, 0.004)]
    for base in others[:30]:
        rows += [base, vectors(draw, base, 1, 0.19)[0]]
    return [(k, v.tolist(), 0) for k, v in enumerate(rows)]


def test_links_beyond_full_lists(spark):
    rows = crowded(np.random.default_rng(4))
    out = descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == brute_vectors(rows)


def test_audit_sees_small_groups(spark):
    # a large group that is found outweighs the links of a pair that is not
    draw = np.random.default_rng(8)
    base, other = np.linalg.qr(draw.normal(size=(24, 2)))[0].T
    x = [*vectors(draw, base, 300, 0.05), other, vectors(draw, other, 1, 0.1)[0]]
    table = spark.createDataFrame([(k, "g", v.tolist(), len(x)) for k, v in enumerate(x)], "id long, grp string, x array<float>, group_size long")
    labels = spark.createDataFrame([(k, 0) for k in range(300)], "node long, component long")
    assert [tuple(r) for r in descent.audit(table, labels).collect()] == [("g", 0.0)]
    alone = table.filter("id in (0, 300)")
    assert descent.audit(alone, labels).collect() == []


def test_label_that_cannot_be_settled_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(descent, "ROUNDS", 0)
    rows = crowded(np.random.default_rng(9))
    out = descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == brute_vectors(rows)


def test_label_without_links_is_settled_by_planted_pairs(spark, monkeypatch):
    """No vector is near another: the trial is planted, and nothing is compared whole."""
    sizes = []
    whole = descent.whole_ties
    monkeypatch.setattr(descent, "whole_ties", lambda vectors, labels: sizes.append(vectors.count()) or whole(vectors, labels))
    draw = np.random.default_rng(12)
    rows = [(k, draw.normal(size=32).tolist(), 0) for k in range(9000)]
    out = descent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in out) and len(out) == 9000
    assert sizes == [0] and out[0].recall >= descent.TARGET


def test_large_label_by_descent(spark, monkeypatch):
    """20,000 vectors of one label, a group of 3,000 among them: links against all pairs by matrix product."""
    sizes = []
    whole = descent.whole_ties
    monkeypatch.setattr(descent, "whole_ties", lambda vectors, labels: sizes.append(vectors.count()) or whole(vectors, labels))
    draw = np.random.default_rng(14)
    unit = lambda v: v / np.linalg.norm(v)
    x = [*vectors(draw, unit(draw.normal(size=32)), 3000, 0.15)]
    while len(x) < 20000:
        base = unit(draw.normal(size=32))
        x += [base] if draw.random() < 0.7 else [*vectors(draw, base, int(draw.integers(2, 40)), 0.12)]
    x = np.array(x[:20000], np.float32)
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in descent.near_vectors(table).collect()}
    full = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(full[k:k + 2000] @ full.T >= descent.LINK).sum(axis=1) - 1 for k in range(0, 20000, 2000)])
    found = np.array([got[k] for k in range(20000)])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    single = (want > 0) & (want < 8)
    assert found[single].sum() >= descent.TARGET * want[single].sum()
    assert sizes == [0]


def test_cosine_of_double_vectors(spark):
    """A pair whose cosine is 0.98 or more only in double precision, and one that is only so after rounding to float."""
    rows, found = [], set()
    draw = np.random.default_rng(2)
    while len(found) < 2:
        v, angle = draw.normal(size=3), np.arccos(0.98) + draw.uniform(-2e-8, 2e-8)
        v /= np.linalg.norm(v)
        side = np.cross(v, draw.normal(size=3))
        w = np.cos(angle) * v + np.sin(angle) * side / np.linalg.norm(side)
        near = lambda a, b: bool(a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98)
        exact, rounded = near(v, w), near(v.astype(np.float32).astype(float), w.astype(np.float32).astype(float))
        if exact != rounded and exact not in found and abs(v @ w - 0.98) > 1e-12:
            found.add(exact)
            rows += [(len(rows), v.tolist(), len(rows), exact), (len(rows) + 1, w.tolist(), len(rows), exact)]
    table = spark.createDataFrame([r[:3] for r in rows], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in descent.near_vectors(table).collect()} == {r[0]: int(r[3]) for r in rows}


def test_one_of_each_group_of_texts_stays(spark):
    """Rows of one id go only as near copies: an unrelated text under the same id stays, whatever its place."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = lambda t: t + " end"
    rows = [(5, a, 1), (5, b, 2), (6, c, 3), (7, near(b), 4), (None, c + "  ", 5), (None, "alone " * 3, 6), (8, near(a), 7), (5, a, 8), (9, None, 9), (9, "", 10)]
    kept = bottomk.keep_one(spark.createDataFrame(rows, "doc_id long, text string, mark int"), words=5)
    assert sorted(r.mark for r in kept.collect()) in ([1, 2, 3, 6, 9, 10], [2, 3, 6, 8, 9, 10])


def test_long_lists_in_several_parts(spark, monkeypatch):
    """Texts that share a passage, some of them near copies, in lists that are dealt over parts."""
    monkeypatch.setattr(bottomk, "PART", 8)
    monkeypatch.setattr(bottomk, "SHORT", 3)
    monkeypatch.setattr(bottomk, "CENTRES", (1, 2))
    draw = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(20))
    texts = {}
    for k in range(120):
        own = [f"q{draw.randrange(10 ** 6)}" for _ in range(draw.choice([3, 6, 30]))]
        texts[len(texts)] = passage + " " + " ".join(own)
        if k % 4 == 0:
            texts[len(texts)] = passage + " " + " ".join([*own[:-1], "other"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert found(bottomk.near_duplicates(docs, 4)) == brute(texts, 4)


def test_long_lists_leave_out_pairs_below_the_limit(spark):
    # sets of 400 hashes that share 320: J = 2/3, above what the lowest 160 values tell apart from 0.8
    draw = random.Random(1)
    common = [draw.getrandbits(62) for _ in range(320)]
    sets = [sorted([*common, *(draw.getrandbits(62) for _ in range(80))]) for _ in range(12)]
    sets += [sorted([*sets[0][:380], *(draw.getrandbits(62) for _ in range(20))])]
    rows = [(1, k, k, len(x), [1], x) for k, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "value long, node long, component long, n long, shared array<long>, items array<long>")
    sides = members.withColumn("fine", bottomk._fine("items")).withColumn("lost", bottomk._lost("fine")).select("node", "shared", "fine", "lost")
    chosen = members.selectExpr("value", "node", "0L AS part", "1L AS parts")
    assert {tuple(sorted((r.a, r.b))) for r in bottomk._close_members(members, chosen, sides, 80).collect()} == {(0, 12)}


def test_filter_of_ids_loses_none(spark):
    rows, ids = spark.range(20_000).withColumn("other", F.col("id") % 7), spark.range(0, 20_000, 50).withColumn("other", F.col("id") % 7)
    want = {r.id for r in ids.collect()}
    for key in (["id"], ["id", "other"]):
        for bits in (64, 16 * len(want)):
            inside, rest = ({r.id for r in bottomk.among(rows, ids, key, bits, within).collect()} for within in (True, False))
            assert want <= inside and not inside & rest and len(inside) + len(rest) == 20_000
        assert len(inside) < 5 * len(want)
    plan = bottomk.among(rows.repartition(5), ids, ["id"], 4096)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("part", [2048, 16])
def test_long_lists_return_no_square_of_links(spark, monkeypatch, part):
    """Sixty copies of one set, sixty sets that share two thirds of it, in components of their own: links grow with the nodes of a block, not with pairs."""
    monkeypatch.setattr(bottomk, "PART", part)
    draw = random.Random(2)
    own = lambda k: [draw.getrandbits(62) for _ in range(k)]
    base = own(400)
    sets = [sorted([*base[:396], *own(4)]) for _ in range(60)] + [sorted([*base[:320], *own(80)]) for _ in range(60)]
    sides = spark.createDataFrame([(k, [1], x) for k, x in enumerate(sets)], "node long, shared array<long>, items array<long>")
    sides = sides.withColumn("fine", bottomk._fine("items")).withColumn("lost", bottomk._lost("fine")).drop("items")
    opened = spark.createDataFrame([(1, k, k, len(x), -1) for k, x in enumerate(sets)], "value long, node long, component long, n long, most long")
    links = [tuple(r) for r in bottomk._close_members(opened, bottomk._chosen(opened, None), sides, 80).collect()]
    assert joined(range(120), links) == {k: 0 if k < 60 else k for k in range(120)}
    blocks = (-(-120 // part)) ** 2
    assert len(links) <= (59 if blocks == 1 else blocks * 2 * part) and len(links) < 60 * 59 / 2


def test_shared_counts_equal_sets(monkeypatch):
    draw = np.random.default_rng(3)
    for often, columns, pairs in ((64, 1024, 1 << 20), (2, 3, 5), (1, 1, 1)):
        monkeypatch.setattr(bottomk, "OFTEN", often)
        monkeypatch.setattr(bottomk, "COLUMNS", columns)
        monkeypatch.setattr(bottomk, "PAIRS", pairs)
        for pool in (6, 60, 600):
            one, other = ([np.unique(draw.integers(0, pool, draw.integers(0, 40))) for _ in range(count)] for count in (9, 14))
            places = lambda sets: np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            got = bottomk._shared_counts(places(one), np.concatenate(one), places(other), np.concatenate(other), (9, 14))
            assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in other] for x in one]

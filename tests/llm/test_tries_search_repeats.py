"""The prefix trie, the ranked search and the removal of long repeats against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logfold.llm import strata, suffixes, trie
from logfold.llm.oracles import ORACLES
from tests import compare

# --- prefix trie ------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {c: (h := zlib.crc32(str(c).encode()) % 6, own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])[1] for c in own}
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, convs in members.items():
        under = [x for x in members if x[:len(node)] == node]
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in under),
            sum(not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in under) for x in under),
            sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 207, -3, 10 ** 12]:
        for turn in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hé", "", None, f"t{rng.randrange(3)}"])))
    rows += [(300, None, "user", "first"), (300, 5, "b", "tie"), (300, 5, "a", "tie"), (300, 5, "a", "tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(400, k, "user", f"turn {k % 7}") for k in range(300)] + [(401, k, "user", f"turn {k % 7}") for k in range(150)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def as_dict(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("local", [10_000, 20, 1])
def test_trie_against_plain_python(spark, talks, local, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    if local == 20:
        monkeypatch.setattr(trie, "LISTED", 1)
    assert as_dict(trie.prefix_trie(spark.createDataFrame(talks, SCHEMA).repartition(5), local)) == plain_trie(talks)


def test_trie_of_odd_tables(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(7, 0, "u", "x", 1, 2), (None, None, None, None, None, None)], SCHEMA + ", depth long, parent long")
    assert as_dict(trie.prefix_trie(odd)) == plain_trie([(7, 0, "u", "x")])


def test_decomposition_of_random_forests():
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        for shape in ("random", "chain", "star"):
            parent = np.array([-1 if k == 0 or rng.random() < 0.05 else {"random": rng.randrange(k), "chain": k - 1, "star": 0}[shape] for k in range(n)])
            values = np.array([[rng.randrange(9) for _ in range(n)], [1] * n])
            weight, want = np.ones(n, np.int64), values.copy()
            for k in range(n - 1, -1, -1):
                if parent[k] >= 0:
                    weight[parent[k]] += weight[k]
                    want[:, parent[k]] += want[:, k]
            assert (trie.decompose(parent, weight, values, np.zeros_like(values)) == want).all()


# --- ranked search ----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    terms = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(plain_terms(text))
    out = {}
    for item, wanted in asked.items():
        scores = []
        for (doc_id, c), size in zip(terms, sizes):
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * size * n // total)))
                        for t, times in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = (doc_id, -score)
    return out


def ranked(df):
    rows = df.collect()
    assert len({(r.item_id, r["rank"]) for r in rows}) == len(rows)
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows}


def test_search_against_plain_python(spark, odd_docs, odd_texts, monkeypatch):
    monkeypatch.setattr(strata, "FIRST_WAVE", 1)
    monkeypatch.setattr(strata, "WIDEN", 2)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6)) % 50}" for _ in range(4000)]
    extra = [(100 + k, " ".join(words[k * 13:k * 13 + rng.choice([1, 5, 30, 200])])) for k in range(250)]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()] + extra
    table = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    items = [(1, "w1 w2 w3 w3 prose The"), (2, None), (3, "w7"), (3, "W8 w9"), (None, "same text w1"), (4, "naïve 日本 ÀÉ"), (5, ""), (6, "nowhere at all")]
    found = strata.search(table, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS term"))
    assert ranked(found) == plain_search(docs, items)
    whole, many = strata.build(table)  # without a vocabulary every term has its lists
    assert {r.term for r in whole.select("term").distinct().collect()} == {t for _, text in docs for t in plain_terms(text)} and many > 200


def test_scores_of_a_visit_are_not_shuffled(spark):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 3} " * (1 + k % 9)) for k in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w2"), (None, "w0 w6")], "item_id long, text string")
    asked = strata.item_terms(items)
    index, many = strata.build(docs, asked.select("term").distinct())
    weights = strata.weigh(asked, index, many)
    wave = strata.materialize(strata.bounds(weights, index).select("item_id", "m"))
    found = strata._visit(wave, weights, index)
    assert found.count() > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(m" in plan and "hashpartitioning(item_id" not in plan


def test_search_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert strata.search(odd_docs, none).collect() == []
    assert strata.search(no_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_length_strata"])
def test_queries_equal_their_sql(spark, small, name):
    from logfold.llm.queries import QUERIES
    assert compare.differences(QUERIES[name](spark, small), compare.connect(small), ORACLES[name]) == []


# --- long repeats -----------------------------------------------------------------------------------------------


def plain_repeats(texts, span=200):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeats(df):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [prose(rng.choice([50, 199, 200, 201, 900])) for _ in range(30)]
    passage, line = prose(330), prose(90)
    texts += [prose(70 + 11 * k) + passage + prose(60) for k in range(12)]  # one passage, all surroundings differ
    texts += [prose(80) + line + prose(120) for _ in range(12)]  # a common line, shorter than the span
    for _ in range(12):  # near copies: single letters changed
        t = list(texts[4] + passage + texts[9])
        for _ in range(rng.choice([0, 1, 3])):
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    texts += [passage[60:260], passage[60:259], passage[:200] + prose(10) + passage[130:], "x" * 900, "ab" * 400, "\x00" * 450 + "q", "y" + "\x00" * 300,
              "é" * 300, "é" * 99 + "e" * 120, texts[3], texts[3], "", None]
    return texts


@pytest.mark.parametrize("hot,part,files", [(50_000, 30_000, 1), (50_000, 20, 7), (3, 40, 5)])
def test_repeats_against_plain_python(spark, copied, monkeypatch, hot, part, files):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "PART", part)
    docs = spark.createDataFrame([(k % 50 or None, t, 1, 2) for k, t in enumerate(copied)], "doc_id long, text string, slice int, entry int").repartition(files)
    assert repeats(suffixes.remove_repeats(docs)) == sorted(plain_repeats(copied))


def test_repeats_of_odd_documents(spark, odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    texts = [t for t in texts if t is None or len(t) < 20_000]  # plain Python is slow on the longest
    docs = odd_docs.filter("text IS NULL OR length(text) < 20000")
    assert repeats(suffixes.remove_repeats(docs)) == sorted(plain_repeats(texts))
    assert suffixes.remove_repeats(no_docs).collect() == []
    assert suffixes.remove_repeats(odd_docs).count() == odd_docs.count()


def test_merge_never_compares_known_prefixes():
    rng = random.Random(4)
    runs = []
    for _ in range(5):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 40)))
        runs.append((strings, [0] + [suffixes.shared_prefix(a, b, 0) for a, b in zip(strings, strings[1:])]))
    compared = []
    plain = suffixes.shared_prefix

    def spy(a, b, since):
        assert a[:since] == b[:since]
        compared.append(since)
        return plain(a, b, since)

    suffixes.shared_prefix = spy
    try:
        out = list(suffixes.merged(runs))
    finally:
        suffixes.shared_prefix = plain
    strings = [runs[r][0][i] for r, i, _ in out]
    assert strings == sorted(s for run, _ in runs for s in run) and sum(compared) > 0
    assert [s for _, _, s in out[1:]] == [plain(a, b, 0) for a, b in zip(strings, strings[1:])]

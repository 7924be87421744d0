"""Quality rules and the quality classifier."""

import re
from collections import Counter

import compare
import numpy as np
import pyarrow as pa
import pytest

from logfold.llm import factors, rules
from logfold.llm import texts as text_slices
from logfold.llm.oracles import ORACLES
from logfold.llm.queries import QUERIES


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(lines), len(re.findall("[A-Z]", text)))


def test_rules_equal_sql(spark, small):
    assert compare.differences(QUERIES["op1_quality_rules"](spark, small), compare.connect(small), ORACLES["op1_quality_rules"]) == []


def test_counts_of_odd_texts(odd_docs):
    names = [x.split()[0] for x in rules.COUNTS.split(", ")]
    got = sorted((r.doc_id, tuple(r[n] for n in names)) for r in rules.measure(odd_docs).collect() if r.doc_id is not None)
    assert got == sorted((r.doc_id, counted(r.text)) for r in odd_docs.collect() if r.doc_id is not None)


def test_rules_on_odd_and_no_documents(odd_docs, no_docs):
    out = rules.quality_rules(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert not any(r.kept for r in out if r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    kept = rules.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in out)
    assert rules.quality_rules(no_docs).collect() == [] and rules.filter_documents(no_docs).columns == no_docs.columns


def test_fences_follow_their_source(spark):
    # symbols are usual in one source and not in the other
    plain = [(k, " ".join(f"word{k}x{i}" for i in range(80)), "en", "plain") for k in range(300)]
    marked = [(1000 + k, " ".join(f"word{k}x{i}" + "#" * (i % 2) for i in range(80)), "en", "marked") for k in range(300)]
    strange = [(5000, marked[0][1], "en", "plain"), (5001, plain[0][1], "en", "marked")]
    out = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(plain + marked + strange, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k, kept in out.items() if not kept] == [5000]


def test_every_fence_differs_between_sources_that_differ(spark):
    """Two sources of other habits: longer words, marks, capitals, and among the documents that repeat lines or words, more of it."""
    rows = []
    for k in range(600):
        for source, much in (("low", 0), ("high", 1)):
            words = [f"{'Word' if much else 'wd'}{'ABC' if much and i % 3 else ''}{k}x{i}" + "#" * (much and i % 2) for i in range(90)]
            lines = [" ".join(words[i:i + 5]) for i in range(0, 90, 5)]
            if k % 2:  # repeated lines and words, in half of the documents
                lines += lines[: 1 + k % 4 // 2 + 3 * much]
            rows.append((2 * k + much, "\n".join(lines), "en", source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["_source"]: r for r in rules.fences(rules.sketches(rules.measure(docs))).filter("_level = 0").collect()}
    for name in rules.MEASURES:
        assert got["high"][f"high_{name}"] > got["low"][f"high_{name}"], name
        assert got["low"][f"docs_{name}"] == (300 if name in rules.SOME else 600)
    assert got["high"]["low_letters_per_word"] > got["low"]["low_letters_per_word"]


def test_fence_of_few_comes_from_a_wider_level(spark):
    """A source with few documents that repeat lines takes that fence from its language, the others from itself."""
    def text(k, again):
        lines = [" ".join(f"w{k}x{i}y{j}" for j in range(6)) for i in range(12)]
        return "\n".join(lines + lines[:again])

    rows = [(k, text(k, 2 if k % 2 else 0), "en", "large") for k in range(600)]
    rows += [(1000 + k, text(k, 0), "en", "rare") for k in range(300)] + [(2000, text(0, 2), "en", "rare")]
    out = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[2000].kept and out[2000].level == 1 and out[1].kept and out[1].level == 0


def test_sketches_merge(spark):
    rows = [(k, " ".join(f"w{j}" * (1 + k % 7) for j in range(60 + k % 40)), "en", f"s{k % 2}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = {tuple(r[:5]): r.n for r in rules.sketches(rules.measure(docs)).collect()}
    parts = Counter()
    for part in (docs.filter("doc_id < 50"), docs.filter("doc_id >= 50")):
        for r in rules.sketches(rules.measure(part)).collect():
            parts[tuple(r[:5])] += r.n
    assert whole == dict(parts)


def test_linear_time_scores_equal_all_pairs():
    draw = np.random.default_rng(1)
    model = {"w0": np.array([0.3]), "w": draw.normal(size=factors.SIZE), "v": draw.normal(size=(factors.SIZE, factors.FACTORS))}
    index, value, offsets = factors.features(pa.array(["a b a c", None, "", "The SAME line\nThe SAME line\n## !!"]))
    got = factors.logits(model, index, value, offsets)
    for row in range(4):
        own = slice(offsets[row], offsets[row + 1])
        i, x = index[own], value[own]
        want = 0.3 + model["w"][i] @ x + sum(model["v"][i[a]] @ model["v"][i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[row] == pytest.approx(want)


def test_classifier_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op2_factorisation_machine"](spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "BAD ### !!") for k in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) AS quality")
    flipped = labels.withColumn("quality", factors.F.when(factors.held_out(factors.F.col("doc_id")), 1 - labels.quality).otherwise(labels.quality))
    one, two = ({r.doc_id: r.score for r in factors.score(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_classifier_on_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (8, None), (9, 1)], "doc_id long, quality int")
    out = factors.score(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    kept = factors.filter_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in out)
    none = labels.limit(0)
    assert {r.score for r in factors.score(odd_docs, none).collect()} == {0.5}
    assert factors.score(no_docs, none).collect() == []


def test_memory_is_given_back_between_slices(monkeypatch):
    """A batch of many slices gives memory back after each, not only at the end of the task."""
    released = []
    monkeypatch.setattr(text_slices, "release", lambda: released.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 50 + [None, ""]})
    got = [(x.num_rows, len(released)) for x in text_slices.slices(iter([batch]), most=100)]
    assert sum(n for n, _ in got) == 52 and [k for _, k in got] == list(range(len(got))) and len(released) == len(got) == 5

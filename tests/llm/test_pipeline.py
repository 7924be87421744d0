"""The pipeline stage by stage, and its packing against the documents that are left."""

import random
import re
import struct
import zlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logfold.llm import packing
from logfold.session import materialize

from .test_duplicates import joined, shingles
from .test_quality import counted


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        left.append(docs.count())
    assert left[0] > left[1] >= left[2] > left[3] == left[4] > 0
    assert docs.filter(F.col("text").rlike(r"[a-z0-9]@mail\\d")).count() == 0
    out = corpus_pipeline.run(spark, folder)
    want = packing.pack(docs).select(F.sum("length"), F.countDistinct("doc_id")).first()
    assert tuple(out.select(F.sum("length"), F.countDistinct("doc_id")).first()) == tuple(want)


def test_odd_tables(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(5, 0, 0), (6, 0, 0), (10, 0, 0), (None, None, None), *((1000 + k, 1, 0) for k in range(30))],
                                   "doc_id long, quality int, toxic int")
    # the odd texts are all too short or repeat themselves: some plain ones are left
    plain = [(1000 + k, " ".join(f"w{k}ord{i}" for i in range(80)), "en", "s", 1, None, None, None) for k in range(30)]
    for k, docs in enumerate((odd_docs.union(spark.createDataFrame(plain, odd_docs.schema)), no_docs)):
        folder = str(tmp_path / str(k))
        labels.write.parquet(f"{folder}/labels.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, folder), name)
        assert (docs.count() > 0) == (k == 0)


MAIL, IP, CARD, PHONE = "jo.smith@mail7.example.com", "10.20.30.40", "4111 1111 1111 1111", "+44 20 7946 0958"


def prose(draw, words, lines=8):
    own = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(own[k::lines]).capitalize() + "." for k in range(lines))


def bucket(value):
    shift = max(value.bit_length() - 6, 0)
    return value >> shift << shift


def inside_fences(texts):
    """Ids that the base rule and the fences over all texts keep; for groups of fewer than 200 documents."""
    measured = {}
    for k, text in texts.items():
        words, chars, symbols, dups, repeats, lines, upper = counted(text)
        if words >= 50 and 100 * repeats <= 50 * words:
            measured[k] = (100 * chars // words, 1000 * symbols // words, 1000 * upper // max(chars, 1), 1000 * dups // max(lines, 1), 1000 * repeats // words)
    kept = set(measured)
    for place, (above, below, some) in enumerate([(200, 200, False), (20, None, False), (150, None, False), (50, None, True), (200, None, True)]):
        sketch = sorted(b for m in measured.values() for b in [bucket(m[place])] if b or not some)
        if sketch:
            first, third = (sketch[-(-len(sketch) * q // 4) - 1] for q in (1, 3))
            wide = 4 * (third - first)
            kept -= {k for k, m in measured.items() if m[place] > third + wide + above or below is not None and m[place] < first - wide - below}
    return kept


def one_of_each_group(texts):
    sets = {k: shingles(x, 5) for k, x in texts.items()}
    links = [(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {k for k, first in joined(list(sets), links).items() if k == first}


@pytest.fixture(scope="module")
def corpus():
    """Texts by id, labels, and ids that are no good, too short, repetitive, full of marks, or near copies."""
    draw = random.Random(5)
    texts, labels = {}, {}
    for k in range(180):
        texts[k] = prose(draw, draw.randint(70, 160))
        labels[k] = 1
    for k in range(200, 290):
        texts[k] = " ".join(draw.choice(["###", "$$$", "click", "win", "free", "|||", "***"]) + str(draw.randint(0, 999)) for _ in range(90))
        labels[k] = 0
    for k in (300, 301):
        texts[k] = prose(draw, 30, 3)
    texts[302] = "\n".join([prose(draw, 20, 1)] * 6)
    texts[303] = texts[4].replace("a", "A").replace("e", "E").replace("o", "O").replace("i", "I").replace("u", "U")
    for k in (310, 311, 312):
        texts[k] = texts[10] + " " + prose(draw, 3, 1)
    texts[313] = texts[11]
    texts[314] = texts[11][: len(texts[11]) // 2]
    for k, found in ((20, MAIL), (21, IP), (22, CARD), (23, PHONE), (24, MAIL)):
        texts[k] += f"\nReach me at {found} today."
    return texts, labels


def test_every_stage_equals_plain_python(spark, corpus, tmp_path):
    texts, labels = corpus
    folder = str(tmp_path)
    spark.createDataFrame([(k, x, "en", "s") for k, x in texts.items()], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame([(k, y, 0) for k, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
        left.append({r.doc_id: r.text for r in docs.collect()})
    # a model is fitted, so what it must do is fixed by the labels: all of the bad ones go, no good one does
    assert set(left[0]) >= {k for k, y in labels.items() if y} and not set(left[0]) & {k for k, y in labels.items() if not y}
    assert all(left[0][k] == texts[k] for k in left[0])
    assert set(left[1]) == inside_fences(left[0]) and not set(left[1]) & {300, 301, 302, 303}
    assert set(left[2]) == one_of_each_group(left[1]) and not set(left[2]) & {310, 311, 312, 313}
    masks = {MAIL: "email", IP: "ip", CARD: "card", PHONE: "phone"}
    assert set(left[3]) == set(left[2])
    for k, text in left[2].items():
        want = text
        for found, kind in masks.items():
            want = want.replace(found, f"[{kind.upper()}]")
        assert left[3][k] == want
    tokenizer, pieces, sequences = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list), defaultdict(list)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(left[3])
    for k, own in pieces.items():
        ids, at = [*tokenizer.encode(left[3][k], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[at:at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert not re.search(r"@mail7", " ".join(left[3].values()))

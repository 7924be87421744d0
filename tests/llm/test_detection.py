"""License scans and personal data against plain Python."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logfold.llm import licenses, pii
from logfold.llm.queries import QUERIES


def reference(text):
    """The scan of one text in plain Python, comparing all detections with all."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = " ".join(words)
    found = []
    known = [(r.priority, r.label, r.pattern, False) for r in licenses.rules()] + [(1, label, phrase, True) for phrase, label in licenses.BASE.items()]
    for k, (priority, label, pattern, base) in enumerate(known):
        for m in re.finditer(licenses._whole(pattern), joined):
            start = joined.count(" ", 0, m.start())
            found.append((start, start + m[0].count(" ") + 1, priority, k, label, base))

    def hidden(d):
        return any(e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and ((e[1] - e[0]) > (d[1] - d[0]) or e[3] < d[3])) for e in found if e is not d)

    base = [d for d in found if d[5]]
    kept = [d for d in found if d[5] or not hidden(d)]
    return (len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in kept})), max((licenses.CONFIDENCE[d[2]] for d in kept), default=0.0))


LINES = [None, "", "Apache License " * 300, "gnu general public license gnu gpl v2 copyright 2020 all rights reserved", "MIT\tLicense; Expat licence Ünlicense cc--by cc by-sa 3.0",
         "SPDX-License-Identifier: Apache-2.0", "This is free and unencumbered software released into the public domain", "public\ndomain", "CC0 1.0 BSD 3-Clause License isc license",
         "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "mit no-attribution", "lapache license", "Licensed under CC BY-NC 4.0."]


def scanned(out):
    return sorted(((r.doc_id is not None, r.doc_id or 0), tuple(r)[1:]) for r in out.collect()) if out.count() else []


def test_licenses_equal_plain_python(spark, small, odd_docs, no_docs):
    lines = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    for docs in (lines, spark.read.parquet(f"{small}/documents.parquet"), odd_docs):
        want = [((r.doc_id is not None, r.doc_id or 0), reference(r.text)) for r in docs.collect()]
        got = [((r.doc_id is not None, r.doc_id or 0), tuple(r)[1:]) for r in licenses.license_scan(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.license_scan(no_docs).collect() == []


def test_scan_is_faster_than_counting_by_ranges(spark, tmp_path):
    """Java tries the ranges of a class in turn; the whole scan must take less than one such count of the words."""
    text = "Erträge on the it is onenerth edonre, ontiatth edes erat as on: oransh of shat erre rely. " * 40
    spark.range(0, 8000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def took(frame):
        since = time.time()
        frame.write.format("noop").mode("overwrite").save()
        return time.time() - since

    ranges = docs.select(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    pairs = [(took(licenses.license_scan(docs)), took(ranges)) for _ in range(3)]
    assert min(x for x, _ in pairs) < min(y for _, y in pairs)


def test_hints_of_every_case_open_the_gate(spark):
    texts = ["CC-BY", "cC\n .bY x", "cc1by", "ccby", "İcc by", "K cc\tBY", "LICENſE", "Mozilla", "no hint", "", "x\x7fCC\x00By"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, _text string").withColumn("open", licenses.gate()).orderBy("doc_id").collect()
    want = [bool(any(h in x.lower() for h in licenses.HINTS) or re.search(r"(?ai)cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by", x)) for x in texts]
    assert [r.open for r in rows] == want and sum(want) == 7


def test_license_plan_has_no_python(spark, small):
    plan = QUERIES["op5_license_rules"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_rules_are_many_and_gated():
    rules = licenses.rules()
    assert len(rules) > 200
    for r in rules:
        re.compile(r.pattern)
        assert 0 <= r.priority < len(licenses.CONFIDENCE)


def base_digest(text):
    """Base spans by the plain patterns."""
    found = []
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(x):
        total = 0
        for k, c in enumerate(x[::-1]):
            total += int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c))))
        return total % 10 == 0

    tests = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15)]
    for kind, (name, pattern, passes) in enumerate(tests):
        found += [(m.start(), kind, m.end(), name) for m in re.finditer(pattern, text or "") if passes(m[0])]
    found.sort()
    counts = tuple(sum(f[1] == k for f in found) for k in range(4))
    return (*counts, hashlib.sha256(",".join(f"{f[3]}:{f[0]}:{f[2]}" for f in found).encode()).hexdigest())


PRIVATE = ["Contact John Smith, john@x.com or call 212-456-7890. SSN 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00 ok password=abc9d8e7f6 version 1.2.3.4",
           "999.1.1.1 1.2.3.4.5.6.7.8 0000001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485 +12 +1234567890123456", "a@b a@b.c.d,e@f.g",
           "plain words The Cat sat", "é 日本 x@y.z 日本 10.0.0.1"]


def test_base_spans_are_exact(spark, small, odd_docs, no_docs):
    private = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    for docs in (private, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd_docs):
        got = sorted((r.doc_id or -1, *tuple(r)[1:6]) for r in pii.find(docs).collect())
        assert got == sorted((r.doc_id or -1, *base_digest(r.text)) for r in docs.collect())
    assert pii.find(no_docs).collect() == []


def test_spans_are_added_and_masked(spark, odd_docs):
    docs = spark.createDataFrame([(k, x, len(x), "y") for k, x in enumerate(PRIVATE)], "doc_id long, text string, n_chars long, places string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert spans[0] == "name:8:18,email:20:30,tel:39:51,ssn:57:68" and spans[6] == "" and "secret:45:55" in spans[1] and spans[1].startswith("iban:5:32")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[0].text == "Contact [NAME], [EMAIL] or call [TEL]. SSN [SSN]" and out[0].n_chars == len(out[0].text)
    assert out[6].text == PRIVATE[6] and out[6].places == "y" and out[6].n_chars == len(PRIVATE[6])
    assert pii.redact(odd_docs).columns == odd_docs.columns and pii.redact(odd_docs).count() == odd_docs.count()


def test_reliabilities_are_recovered():
    draw = np.random.default_rng(6)
    truth = draw.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where(draw.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[draw.random(votes.shape) < 0.3] = 0
    code, count = np.unique(((votes + 1) * 3 ** np.arange(4)).sum(axis=1), return_counts=True)
    true, table = pii.weigh(np.full(len(code), 4), code, count.astype(float))
    says = table[:, 1, 2] / (table[:, 1, 2] + table[:, 1, 0])
    assert np.abs(says - right).max() < 0.05
    found = dict(zip(code.tolist(), true, strict=True))
    assert np.mean((np.array([found[c] for c in ((votes + 1) * 3 ** np.arange(4)).sum(axis=1)]) > 0.5) == truth) > 0.93


def test_long_secrets_are_masked_whole(spark):
    draw = random.Random(2)
    made = lambda n, own="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(draw.choices(own, k=n))
    secrets = [f"{made(36)}.{made(52)}.{made(42)}", made(87), made(87), made(128, "0123456789abcdef"), "ghp_" + made(60), made(50_000)]
    texts = [x.format(s) for x, s in zip(["token={} end", 'the api_key: "{}" end', "secret={}", "key {} end", "token {} end", "secret={} end"], secrets, strict=True)]
    for text, secret in zip(texts, secrets, strict=True):
        spans = [text[s.start:s.end] for s in pii.candidates(text, pii.base_spans(text)) if pii.KINDS[s.kind] == "secret"]
        assert spans == [secret]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[0] == "token=[SECRET] end" and out[1] == 'the api_key: "[SECRET]" end' and out[2] == "secret=[SECRET]" and out[5] == "secret=[SECRET] end"


def test_cheap_look_lets_every_proposal_through():
    texts = ['password: "correcthorsebattery"', 'the password = "correcthorsebattery" it is', "pwd=correcthorsebattery", "token ghp_" + "abcdefghijkl" * 3, "xoxb-abcdefghijkl",
             "AKIA" + "ABCDEFGH" * 2, "key " + "abcdef" * 6, "mail x@y.z", "by Ada B. Lovelace", "dear Ada Lovelace", "call 212-456-7890"]
    spans = [[(p["kind"], x[p["start"]:p["end"]]) for p in own] for x, own in zip(texts, pii._places(pa.array(texts)), strict=True)]
    assert all(spans), spans
    assert spans[0] == [(7, "correcthorsebattery")]
    # a digit elsewhere changes nothing
    for x, own in zip(texts, spans, strict=True):
        later = [(p["kind"], (x + " 1")[p["start"]:p["end"]]) for p in pii._places(pa.array([x + " 1"]))[0]]
        assert later == own


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("a1.@-+ %x0(") for _ in range(draw.randrange(40)))
        want = [(0, *m.span()) for m in pii.EMAIL.finditer(text)]
        want += [(k, *m.span()) for k, pattern, passes in ((1, pii.IP, pii._ip), (2, pii.CARD, pii._card), (3, pii.PHONE, pii._phone))
                 for m in pattern.finditer(text) if passes(m[0])]
        assert pii.base_spans(text) == want, text


@pytest.mark.parametrize("text", [
    "7" * 1_000_000, "x" * 1_000_000 + "@", "@" + "x" * 1_000_000, "a@" * 300_000, "1." * 400_000, "a.b@c" * 150_000, "0" * 20_000 + "1.2.3.4 ",
    "me@example.org " * 50_000, "f" * 1_000_000 + "g", "=" + "y" * 500_000 + "Z", "A" + "b" * 500_000 + " C"])
def test_long_runs_take_linear_time(text):
    begin = time.process_time()
    base = pii.base_spans(text)
    pii.candidates(text, base)
    assert time.process_time() - begin < 6  # some 1 s; with quadratic patterns hours

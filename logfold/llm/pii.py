"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Patterns propose candidate spans. Four of the kinds (``BASE``) have exact rules and are always kept.
2. Four labelers vote yes, no or nothing on every candidate: its shape, a check or gazetteer, the words around
   it, and the characters next to it.
3. Counts of vote patterns over all documents go through expectation-maximisation, which estimates how each
   labeler votes on true and false candidates and the share of true ones per kind. There are at most 3^4 patterns
   per kind and length class, so the counts are of a fixed size.
4. A logistic classifier over kind, votes and length is trained on EM's probabilities; candidates at ``SURE`` or
   more are added.

Null text: no spans. Repeated rows and ids are searched one by one. Very long texts are read whole. An empty table
gives an empty result. Columns other than doc_id and text are not read by ``find``; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.texts import slices, text_of
from logfold.session import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "tel", "ssn", "iban", "secret", "name")
LABELERS = 4
#: Probability from which a candidate is added.
SURE = 0.5
#: Characters around a candidate that the context labeler reads.
AROUND = 40

# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same matches in linear time: an e-mail starts where the run of characters before its @ does, an address at the
# head of a run of digits, and what such a run fails to be its rest fails to be too.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_HEAD_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")

TEL = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])")
SSN = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
# no upper bounds: the end of a run of its characters ends a secret
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|xox[abp]-[0-9A-Za-z-]{10,}|[0-9a-f]{32,}"
                    r"|(?<==)[^\s\"'=]{8,}|(?<== \")[^\s\"']{8,}|(?<=: \")[^\s\"']{8,})(?![0-9A-Za-z])")
#: What every secret holds or follows, and what any span holds or follows; read by Arrow too.
SECRET_LOOK = "[0-9=\"]|AKIA|gh[pousr]_|xox[abp]-|[a-f]{32}"
LOOK = SECRET_LOOK + "|@|[A-Z][a-z]+ (?:[A-Z]\\. )?[A-Z][a-z]"
#: Overlapping proposals: every pair of neighbours is looked at.
NAME = re.compile(r"(?<![0-9A-Za-z])(?=([A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]+(?![0-9A-Za-z])))")

# Gazetteers.
FIRST_NAMES = frozenset("""
james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica
thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley
steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah
edward stephanie ronald rebecca timothy laura jason helen jeffrey cynthia ryan amy jacob angela gary anna alice bob
hans peter klaus stefan ursula monika sabine andreas pierre jean marie claude sophie nathalie jose maria carlos
carmen juan antonio luis ana elena pablo lucia""".split())
LAST_NAMES = frozenset("""
smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson
thomas taylor moore jackson martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young
allen king wright scott torres nguyen hill flores green adams nelson baker hall rivera campbell mitchell carter
roberts mueller schmidt schneider fischer weber meyer wagner becker dupont durand bernard dubois moreau laurent doe
fernandez alvarez ruiz diaz""".split())
DOMAIN_ENDS = frozenset("com org net edu gov info biz io co de fr es uk us eu ch at it nl".split())
IBAN_SIZES = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "CH": 21, "AT": 20, "BE": 16}
# Words that speak for or against a kind.
HINTS = {
    "email": ("mail contact write reach", ""), "ip": ("ip address host server login from", "version release section"),
    "card": ("card visa credit debit payment pay", "order isbn serial invoice"), "phone": ("phone call tel mobile fax contact", "version"),
    "tel": ("phone call tel telephone mobile cell fax contact number dial", "version order isbn part serial item"),
    "ssn": ("ssn social security number id", "version order isbn part serial item"),
    "iban": ("iban account bank transfer", "part serial"),
    "secret": ("password passwd pwd token secret key api credential auth", "checksum commit sha md5 hash etag"),
    "name": ("name mr mrs ms dr prof contact author signed dear sincerely regards by called", "street city river university"),
}


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    votes: int
    length: int


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _card(x: str) -> bool:
    own = _digits(x)
    return 12 <= len(own) <= 19 and luhn(own)


def _ip(x: str) -> bool:
    parts = [p.lstrip("0") for p in x.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _phone(x: str) -> bool:
    return 9 <= len(_digits(x)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans that EMAIL finds."""
    at = 0
    for run in _LOCAL.finditer(text):
        start = max(run.start(), at)  # the last address may have taken the head of this run
        if start < run.end() and text[run.end():run.end() + 1] == "@":
            domain = _DOMAIN.match(text, run.end() + 1)
            if domain:
                at = domain.end()
                yield start, at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds: leftmost matches that pass their check, without retries."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    if _ANY_DIGIT.search(text):
        for kind, pattern, passes in ((1, _HEAD_IP, _ip), (2, CARD, _card), (3, PHONE, _phone)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if passes(m[0])]
    return out


_ANY_DIGIT = re.compile("[0-9]")
_MAYBE_SECRET = re.compile(SECRET_LOOK)
_WORD = re.compile("[A-Za-z]+")


def _iban(x: str) -> int:
    own = x.replace(" ", "")
    if IBAN_SIZES.get(own[:2], len(own)) != len(own):
        return -1
    return 1 if int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1 else -1


def _mixed(x: str) -> int:
    """Random-looking: several changes between letters and digits."""
    kinds = [c.isdigit() for c in x if c.isalnum()]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return 1 if len(x) >= 12 and turns >= 4 else -1 if turns == 0 else 0


def shape_vote(kind: str, x: str) -> int:
    if kind == "tel":
        own = _digits(x)
        return 1 if own[0] in "23456789" and own[3] in "23456789" and len(set(own)) > 2 else -1
    if kind == "ssn":
        own = _digits(x)
        return -1 if own[:3] in ("000", "666") or own[0] == "9" or own[3:5] == "00" or own[5:] == "0000" else 1
    if kind == "secret":
        return 1 if x.startswith(("AKIA", "gh", "xox")) and len(x) >= 20 else _mixed(x)
    if kind == "name":
        return 0
    return 1


def list_vote(kind: str, x: str) -> int:
    """Checks and gazetteers."""
    if kind == "email":
        return 1 if x.rpartition(".")[2].lower() in DOMAIN_ENDS else 0
    if kind == "iban":
        return _iban(x)
    if kind == "card":
        return 1 if x[0] in "3456" else 0
    if kind == "name":
        first, last = x.split()[0].lower(), x.split()[-1].lower()
        return (first in FIRST_NAMES) + (last in LAST_NAMES) - 1
    if kind == "secret":
        return 1 if x.startswith(("AKIA", "ghp_", "xoxb-", "xoxp-")) else 0
    return 0


def context_vote(kind: str, before: str, after: str) -> int:
    """The last words before the span, and the first one after it."""
    near = {w.lower() for w in _WORD.findall(before)[-4:] + _WORD.findall(after)[:1]}
    yes, no = HINTS[kind]
    return 1 if near & set(yes.split()) else -1 if near & set(no.split()) else 0


def edge_vote(kind: str, before: str, after: str) -> int:
    """A span inside of a longer run of characters is suspicious; an assignment or a quote speaks for a secret."""
    if kind == "secret":
        return 1 if before.rstrip(" \"'")[-1:] in ("=", ":") else 0
    return -1 if before[-1:].isalnum() or after[:1].isalnum() else 0


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[Span]:
    """Base spans and further proposals with their votes; proposals within a base span are left out."""
    found = list(base)
    taken = sorted((s, e) for _, s, e in base)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    proposals: list[tuple[int, re.Pattern]] = []
    if _ANY_DIGIT.search(text):
        proposals += [(4, TEL), (5, SSN), (6, IBAN)]
    if _MAYBE_SECRET.search(text):
        proposals.append((7, SECRET))
    proposals.append((8, NAME))
    for kind, pattern in proposals:
        for m in pattern.finditer(text):
            start, end = m.span(pattern.groups)
            if kind == 8 and list_vote("name", text[start:end]) < 0 and context_vote("name", text[max(0, start - AROUND):start], "") <= 0:
                continue
            before = bisect_right(starts, start)  # base spans that start at or before it
            if not before or furthest[before - 1] < end:
                found.append((kind, start, end))
    out = []
    for kind, start, end in found:
        name, own = KINDS[kind], text[start:end]
        before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
        votes = (shape_vote(name, own), list_vote(name, own), context_vote(name, before, after), edge_vote(name, before, after))
        out.append(Span(kind, start, end, sum((v + 1) * 3 ** k for k, v in enumerate(votes)), min(7, len(own) // 8)))
    return out


def votes_of(code: np.ndarray) -> np.ndarray:
    """Votes -1, 0, 1 by labeler."""
    return np.stack([code // 3 ** k % 3 - 1 for k in range(LABELERS)], axis=1)


def weigh(kind: np.ndarray, code: np.ndarray, count: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each pattern, table of P(vote | truth) by labeler) by expectation-maximisation.

    The start is that labelers that vote are right six times as often as wrong; it counts as ``20`` observations, and a share of
    0.4 true candidates as 10, so that rare patterns cannot turn the meaning of a vote around.
    """
    votes = votes_of(code) + 1
    start = np.array([[0.45, 0.45, 0.1], [0.05, 0.35, 0.6]])  # [truth][vote]
    table = np.repeat(start[None], LABELERS, axis=0)
    share = np.full(len(KINDS), 0.4)
    for _ in range(rounds):
        odds = np.log(share[kind] / (1 - share[kind]))
        for k in range(LABELERS):
            odds = odds + np.log(table[k, 1, votes[:, k]] / table[k, 0, votes[:, k]])
        true = 1 / (1 + np.exp(-odds))
        for k in range(LABELERS):
            for truth, weight in ((0, count * (1 - true)), (1, count * true)):
                own = np.bincount(votes[:, k], weight, 3) + 20 * start[truth]
                table[k, truth] = own / own.sum()
            # a yes must not speak against, nor a no for: else two kinds could swap their meaning
            ratio = table[k, 1] / table[k, 0]
            if not ratio[0] <= 1 <= ratio[2]:
                table[k] = start
        share = (np.bincount(kind, count * true, len(KINDS)) + 4) / (np.bincount(kind, count, len(KINDS)) + 10)
    return true, table


def inputs(kind: np.ndarray, code: np.ndarray, length: np.ndarray) -> np.ndarray:
    votes = votes_of(code)
    return np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[votes[:, k] + 1][:, [0, 2]] for k in range(LABELERS)), np.eye(8)[length]], axis=1)


class Model(NamedTuple):
    weights: np.ndarray
    reliability: np.ndarray

    def probability(self, kind: np.ndarray, code: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(kind, code, length) @ self.weights, -30, 30)))


def train(kind: np.ndarray, code: np.ndarray, length: np.ndarray, count: np.ndarray) -> Model:
    """The span classifier, from the counts of all candidates."""
    true, table = weigh(kind, code, count)
    x = inputs(kind, code, length)
    weights = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (count * (p - true)) + 0.05 * weights
        curve = (x * (count * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(weights))
        weights = weights - np.clip(np.linalg.solve(curve, slope), -3, 3)
    return Model(weights, table)


_PLACES_TYPE = "array<struct<kind:int,start:long,end:long,votes:int,length:int>>"


def _places(texts: pa.Array) -> list[list[dict]]:
    """The candidates of each text; a cheap look by Arrow leaves most texts alone."""
    maybe = pc.match_substring_regex(texts, LOOK).to_pylist()
    return [[s._asdict() for s in candidates(x, base_spans(x))] if hit else [] for x, hit in zip(texts.to_pylist(), maybe, strict=True)]


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, _text, by its candidates."""
    fields = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("length", pa.int32())]))
    for batch in slices(batches, "_text"):
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(_places(batch.column("_text")), fields)],
                                         names=[*batch.schema.names[:-1], "places"])


def fit(proposed: DataFrame) -> Model:
    """Learn from the candidates of all documents; only counts per pattern, of a fixed size, reach the driver."""
    rows = (proposed.select(F.explode("places").alias("p")).groupBy("p.kind", "p.votes", "p.length").count()
            .orderBy("kind", "votes", "length").collect())
    column = lambda k: np.array([r[k] for r in rows], np.int64)
    return train(column(0), column(1), column(2), column(3).astype(np.float64))


def _chooser(model: Model) -> Callable[[list[dict]], list[dict]]:
    known: dict[tuple[int, int, int], bool] = {}

    def choose(places: list[dict]) -> list[dict]:
        out = []
        for p in places:
            key = (p["kind"], p["votes"], p["length"])
            if key not in known:
                known[key] = p["kind"] < len(BASE) or bool(model.probability(*(np.array([x]) for x in key))[0] >= SURE)
            if known[key]:
                out.append(p)
        return sorted(out, key=lambda p: (p["start"], p["kind"], p["end"]))

    return choose


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans; one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    proposed = docs.select("doc_id", text_of().alias("_text")).mapInArrow(_propose, f"doc_id {kind}, places {_PLACES_TYPE}")
    proposed = materialize(proposed, "places")
    model = fit(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = _chooser(model)
        written = lambda own: ",".join(f"{KINDS[p['kind']]}:{p['start']}:{p['end']}" for p in own)
        for batch in batches:
            chosen = [choose(x or []) for x in batch.column("places").to_pylist()]
            base = [[p for p in own if p["kind"] < len(BASE)] for own in chosen]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(pa.array([sum(p["kind"] == k for p in own) for own in base], pa.int64()) for k in range(len(BASE))),
                pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own in base]), pa.array([written(own) for own in chosen])],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return proposed.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def masked(text: str, places: list[dict]) -> str:
    """The text with spans replaced by their kind; spans that overlap become one."""
    out, at = [], 0
    for p in places:
        if p["start"] >= at:
            out += [text[at:p["start"]], f"[{KINDS[p['kind']].upper()}]"]
        at = max(at, p["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars, if there is such a column, follows the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    proposed = docs.select("doc_id", text_of().alias("_text")).mapInArrow(_propose, f"doc_id {kind}, places {_PLACES_TYPE}")
    model = fit(proposed.select("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = _chooser(model)
        for batch in slices(batches, "text"):
            text = pc.fill_null(batch.column("text"), "")
            new = pa.array([None if old is None else masked(old, choose(own)) if own else old
                            for old, own in zip(batch.column("text").to_pylist(), _places(text), strict=True)], batch.schema.field("text").type)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": new}
            if "n_chars" in columns:
                size = pc.utf8_length(new).cast(columns["n_chars"].type)
                columns["n_chars"] = pc.if_else(pc.equal(pc.fill_null(new, ""), text), columns["n_chars"], size)
            yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

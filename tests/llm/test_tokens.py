"""Token operators against the libraries."""

import hashlib
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logfold.llm import counting, encoding, packing, wavelet, wordtable
from logfold.llm.queries import QUERIES


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_wavelet_access_rank_and_select():
    draw = np.random.default_rng(2)
    for ids in (draw.integers(0, 50, 5000), draw.integers(0, 70_000, 3000), np.array([7, 7, 7]), draw.geometric(0.1, 1500)):
        ids = ids.astype(np.uint32)
        matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, np.array([1]), np.array([True]), np.array([len(ids)])).to_bytes())
        assert matrix.decode().tolist() == ids.tolist()
        for at in draw.integers(0, len(ids), 50).tolist():
            token = int(ids[at])
            assert matrix.access(at) == token
            assert matrix.rank(token, at) == int((ids[:at] == token).sum()) and matrix.rank(token) == int((ids == token).sum())
            places = np.flatnonzero(ids == token).tolist()
            assert matrix.select(token, places.index(at)) == at
        assert matrix.occurrences(token) == places
        assert matrix.rank(1 << 20) == 0
        with pytest.raises(IndexError):
            matrix.access(len(ids))
        with pytest.raises(IndexError):
            matrix.select(token, len(places))


def test_wavelet_files_hold_all_documents(spark, small, words):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_wavelet_matrix"](spark, small).collect()}
    start, want = 0, {}
    for name, text in sorted(texts_of(docs)):
        ids = [*ids_of(words, text), 1]
        want[name] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == want


def test_wavelet_of_odd_documents(spark, odd_docs, no_docs, words, tmp_path):
    wavelet.write(odd_docs, str(tmp_path / "shards"), most=500)
    rows = sorted(wavelet.documents(spark, str(tmp_path / "shards")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in texts_of(odd_docs)), key=lambda x: (x is not None, x or 0))
    assert sorted(bytes(r.ids) for r in rows) == sorted(np.array([*ids_of(words, x), 1], "<u4").tobytes() for _, x in texts_of(odd_docs))
    assert wavelet.round_trip(no_docs).collect() == []


def test_remembered_words_are_encoded_alike(words, monkeypatch):
    """Slices of the same words, new ones and marks after letters, in a table that has to forget; few calls of the model."""
    draw = np.random.default_rng(5)
    stems = ["".join(draw.choice(list("abcdeéßÀnorst"), draw.integers(1, 9))) for _ in range(400)]
    tails = ["", "", ".", ",", "!!", "###", "&&&.", "%%%", "$$$,", "***", "?)", "'s", "-x", "³", "<|endoftext|>", "|>", "\x01", "12", "\u0301."]
    encoder = encoding.WordEncoder(most=900)
    asked = []
    of_words = encoder.of_words
    monkeypatch.setattr(encoder, "of_words", lambda x: asked.extend(x) or of_words(x))
    for size in (300, 300, 300, 2000, 0, 1, 300):
        texts = [" ".join(str(draw.choice(stems)) + str(draw.choice(tails)) for _ in range(size // 10)) for _ in range(10)] + [None, "", " \n"]
        for again in range(2):
            asked.clear()
            ids, offsets = encoder.encode(pa.array(texts), 1)
            assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[*ids_of(words, x), 1] for x in texts]
            assert len(asked) == len(set(asked)) and not (again and size == 300 and asked)
        flat, offsets = encoder.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids_of(words, x) for x in texts]


def test_letters_with_marks_cost_one_call_of_the_model(words):
    """A stem with many tails goes to the merge model once, and no tail makes the library split the whole word."""
    encoder, calls = encoding.WordEncoder(), []
    library = encoder.encode_words
    encoder.encode_words = lambda x: calls.extend(x) or library(x)
    texts = pa.array(["thonre thonre. thonre!! thonre### onnten### onnten.&&& onnten%%%"])
    ids, _ = encoder.encode(texts)
    assert ids.tolist() == ids_of(words, texts[0].as_py()) and sorted(calls) == ["!!", "###", "%%%", ".", ".&&&"]


def chain_cost(chain, prices, width):
    return sum(width - (b - a) + prices.get(b, 0) for a, b in zip([0, *chain], chain, strict=False))


def test_cuts_are_the_cheapest():
    draw = np.random.default_rng(4)
    for _ in range(60):
        places = np.cumsum(draw.integers(1, 9, draw.integers(1, 60)))
        prices = draw.choice([0, 6, 24], len(places))
        prices[-1] = 0
        width, by = 16, dict(zip(places.tolist(), prices.tolist(), strict=True))
        best = {0: 0}  # cheapest chain to every place, by trying all starts
        for p in places.tolist():
            best[p] = min(best[q] + width - (p - q) + by[p] for q in best if 0 < p - q <= width)
        end = int(places[-1])
        got = packing.cuts(places, prices, True, width)
        assert got[-1] == end and all(0 < b - a <= width for a, b in zip([0, *got], got, strict=False))
        options = [best[q] + packing.tail(end - q, width)[0] for q in best if end - q <= width]
        tailed = []
        for k in range(len(got) + 1):  # the cost of the chain found, with its last windows read as a tail
            head = got[:k]
            rest = end - (head[-1] if head else 0)
            if set(head) <= set(best) and [b - a for a, b in zip([head[-1] if head else 0, *got[k:]], got[k:], strict=False)] == packing.tail(rest, width)[1]:
                tailed.append(chain_cost(head, by, width) + packing.tail(rest, width)[0])
        assert min(tailed) == min(options)


def packed(rows, texts, words, width):
    """Check the pieces of documents with distinct ids; the share of padding."""
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    ids = {k: [*ids_of(words, x), 1] for k, x in texts}
    used, done = {}, dict.fromkeys(ids, 0)
    for r in rows:
        assert r.offset == used.get(r.sequence_id, 0) and r.start == done[r.doc_id] and r.length > 0
        assert r.doc_tokens == len(ids[r.doc_id]) and bytes(r.ids) == np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        used[r.sequence_id] = r.offset + r.length
        done[r.doc_id] += r.length
    assert done == {k: len(x) for k, x in ids.items()} and max(used.values()) <= width
    padding = sum(0 if n & (n - 1) == 0 else width - n for n in used.values())
    return padding / (padding + sum(used.values()))


def test_packing_places_every_token_once(spark, small, words):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert packed(packing.pack(docs).collect(), texts_of(docs), words, packing.WIDTH) < 0.02
    assert packed(packing.pack(docs, width=128).collect(), texts_of(docs), words, 128) < 0.2


def test_packing_crosses_blocks(spark, small, words, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3000)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).coalesce(1)
    assert packed(packing.pack(docs, width=512).collect(), texts_of(docs), words, 512) < 0.1


def test_blocks_hold_few_tokens_beyond_their_size(small, words, monkeypatch):
    """A slice of many documents is cut into blocks: what is held at a time does not grow with the slice."""
    held, choices = [], packing.choices
    monkeypatch.setattr(packing, "choices", lambda ids, ends, stops: held.append((len(ids), int(np.diff(ends, prepend=0).max()))) or choices(ids, ends, stops))
    monkeypatch.setattr(packing, "BLOCK", 5000)
    texts = [(k, "one two three. four five six! " * (k % 40)) for k in range(700)]
    run = []
    frame = types.SimpleNamespace(mapInArrow=lambda f, schema: run.append(f))
    monkeypatch.setattr(packing, "in_order", lambda docs: frame)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 3))
    packing.pack(types.SimpleNamespace(schema={"doc_id": types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "bigint"))}), width=512)
    batch = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in texts], "_text": [x for _, x in texts]})
    rows = [types.SimpleNamespace(**row) for out in run[0](iter([batch])) for row in out.to_pylist()]
    assert packed(rows, texts, words, 512) < 0.1
    assert len(held) > 10 and all(size <= 5000 + longest + 512 for size, longest in held)


def test_packing_odd_documents(odd_docs, no_docs, words):
    rows = packing.pack(odd_docs).collect()
    lengths = sorted(len(ids_of(words, x)) + 1 for _, x in texts_of(odd_docs))
    assert sum(r.length for r in rows) == sum(lengths)
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == lengths
    assert packing.pack(no_docs).collect() == []


def digests(tokenizer, text):
    ids = ids_of(tokenizer, text)
    return (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))))


def test_word_table(spark, small, odd_docs, no_docs, words):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd_docs):
        got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wordtable.encode_decode(docs).collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
        assert sorted(got, key=key) == sorted(((k, *digests(words, x)) for k, x in texts_of(docs)), key=key)
    assert wordtable.encode_decode(no_docs).collect() == []


def test_counts(spark, small, odd_docs, no_docs, pieces):
    for docs, chunk, overlap in ((spark.read.parquet(f"{small}/documents.parquet"), counting.CHUNK, counting.OVERLAP),
                                 (spark.read.parquet(f"{small}/documents.parquet"), 900, 24), (odd_docs, 20_000, 64)):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in counting.token_counts(docs, chunk=chunk, overlap=overlap).collect())
        want = [(k or -1, len((x or "").encode()), len(pieces.encode(x or ""))) for k, x in texts_of(docs)]
        assert got == sorted((*w, w[2] > 4096) for w in want)
    assert counting.token_counts(no_docs).collect() == []


def test_overlaps_widen(spark, pieces):
    texts = ["a" * 5000, "a b" * 3000, " " * 4000, ("x" * 3000 + " ") * 4, "日本" * 2000, "a▁b c" * 900, "\n\n \n" * 900, " a" * 2500, "   a" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in counting.token_counts(docs, chunk=700, overlap=16).collect()}
    assert got == {k: len(pieces.encode(x)) for k, x in enumerate(texts)}
    assert counting.has_stable_spaces(pieces)

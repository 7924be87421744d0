"""Encoding whole texts with the tokenizers library, each distinct word of a task once.

The library drops white space and never merges across it, so a text's ids are those of its words in order. Words
are looked up in a table of the Python worker, an Arrow column beside numpy arrays of their ids, which holds at most
``MOST`` words: when it is full, the half that was used last stays. Letters of unknown words go to the library's merge
model alone, with marks that follow them apart; other words are encoded together, with a control character between
them whose single id marks the ends. The path of the vocabulary is a parameter; a vocabulary for which any of this does
not hold is refused.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.texts import text_of, words_of

END = 1
#: Words that a worker remembers, at some 60 bytes each; bytes of text that are encoded at a time.
MOST, SLICE = 600_000, 4 << 20
_MARK = "\x01"
#: Marks that may follow letters: always pieces of their own.
_MARKS = ".,!?;:)#$%&*"
_PARTS = re.compile(f"([a-zà-öø-ÿA-ZÀ-ÖØ-Þ]+)([{re.escape(_MARKS)}]*)")
#: What a vocabulary must treat alike to be encoded word by word.
_PROBES = ("don't stop", "Ab\tc\nd  e\x0bf\x0c g ", "ÀÉ naïve été", "x1 22,, a.b (c) é́", "日本 語", "'s 123 !!,, 's")


def vocabulary(name: str) -> str:
    """The place of a vocabulary file on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as one flat array; remembers the words it has met, up to ``most`` of them beside those of one slice."""

    def __init__(self, file: str = "word_bpe_49k.json", most: int = MOST):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(file))
        self.most = most
        mark = self._plain(_MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        # bytes beyond ASCII have letters of their own in the merge model's alphabet
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else lambda x: [(x, None)]
        self.spelt = {ord(c): "".join(x for x, _ in split(c)) for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"}
        self._forget()
        self._check(file)

    def _check(self, file: str) -> None:
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        alike = all("<|" in t for t in special)
        for text in _PROBES:
            words = text.split()
            whole = self._plain(text)
            alike &= whole == [i for w in words for i in self._plain(w)] == [i for w in words for i in self._plain(w.translate(_LOWER))]
        for word in ("a", "naïve", "ÀÉ", "thonre", "onnten", "Zürich", "w" * 300):
            alike &= self._plain(word) == self._letters(word)
            alike &= all(self._plain(word + tail) == self._plain(word) + self._plain(tail) for c in _MARKS for tail in (c, c * 3, c + ".,"))
        if not alike:
            raise ValueError(f"{file}: not a lower-casing vocabulary that drops white space and keeps words apart")

    def _letters(self, word: str) -> list[int]:
        """Ids of a word of letters."""
        return [x.id for x in self.tokenizer.model.tokenize(word if word.isascii() and word.islower() else word.lower().translate(self.spelt))]

    def _forget(self) -> None:
        self.words = pa.chunked_array([], pa.string())
        # the first place is that of the id that ends a row
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.int32)
        self.used, self.clock = 1, 0

    def _shrink(self) -> None:
        """Keep the half of the words that was used last."""
        have = len(self.words)
        stay = np.sort(np.argsort(self.seen[:have], kind="stable")[have - min(have, self.most // 2):])
        words, (ids, sizes) = self.words.take(pa.array(stay)).combine_chunks(), self._ids_at(stay)
        seen, clock = self.seen[stay], self.clock
        self._forget()
        self._store(words, ids, sizes)
        self.seen[:len(stay)], self.clock = seen, clock

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words without the mark and without special tokens, by the library."""
        if self.mark is None:
            found = [self._plain(w) for w in words]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 20_000):
            whole = f" {_MARK} ".join(words[at:at + 20_000])
            flat = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
            marks = flat == self.mark
            sizes.append(np.diff(np.concatenate(([-1], np.flatnonzero(marks), [len(flat)]))) - 1)
            ids.append(flat[~marks])
        return np.concatenate(ids), np.concatenate(sizes)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct words, each encoded once; nothing is remembered."""
        stems: dict[str, int] = {"": 0}  # letters, by the merge model
        others: dict[str, int] = {"": 0}  # marks after letters, and words that are not letters and marks
        alone: dict[str, int] = {}  # a word with the mark, or one that may hold a special token
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts = _PARTS.fullmatch
        for k, word in enumerate(words):
            found = parts(word)
            if found:
                stem, tail = found.groups()
                first[k] = stems.setdefault(stem, len(stems))
                if tail:
                    second[k] = others.setdefault(tail, len(others))
            elif _MARK in word or "<|" in word:
                second[k] = -1 - alone.setdefault(word, len(alone))
            else:
                second[k] = others.setdefault(word, len(others))
        ids, sizes, tokenize, spelt = array("I"), array("q"), self.tokenizer.model.tokenize, self.spelt
        for stem in stems:
            pieces = tokenize(stem if stem.isascii() and stem.islower() else stem.lower().translate(spelt)) if stem else ()
            ids.extend([x.id for x in pieces])
            sizes.append(len(pieces))
        other_ids, other_sizes = self.encode_words(list(others)[1:])
        own = [self._plain(word) for word in alone]
        ids = np.concatenate((np.array(ids, np.uint32), other_ids, np.array([i for x in own for i in x], np.uint32)))
        sizes = np.concatenate((np.array(sizes, np.int64), [0], other_sizes, [len(x) for x in own])).astype(np.int64)
        second = np.where(second < 0, len(stems) + len(others) - 1 - second, second + len(stems))
        ends, pairs = np.cumsum(sizes), np.stack((first, second), axis=1).reshape(-1)
        own = sizes[pairs]
        return ids[_ranges(ends[pairs] - own, own)], own[::2] + own[1::2]

    def _store(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        have, ends = len(self.words), self.used + np.cumsum(sizes)
        while have + len(words) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
            self.seen = np.concatenate((self.seen, np.zeros_like(self.seen)))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ends[have:have + len(words)] = ends
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.words = pa.chunked_array([*self.words.chunks, words], pa.string())

    def _spans(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, stop) places in the ids of remembered words."""
        return np.where(where > 0, self.ends[where - 1], 1), self.ends[where]

    def _ids_at(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of remembered words, one after the other."""
        since, until = self._spans(where)
        return self.ids[_ranges(since, until - since)], until - since

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are remembered; -1 for unknown ones, which are learned at the end."""
        where = np.full(len(words), -1)
        if len(self.words):
            found = pc.index_in(self.words, value_set=words).combine_chunks()
            where[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        new = np.flatnonzero(where < 0)
        if len(new):
            where[new] = np.arange(len(self.words), len(self.words) + len(new))
            unknown = words.take(pa.array(new))
            self._store(unknown, *self.of_words(unknown.to_pylist()))
        return where

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): row i has ids[offsets[i]:offsets[i + 1]]; ``end`` is appended to each row."""
        texts = pc.fill_null(texts, "")
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        # the vocabulary is lower case; only ASCII is folded here, and never where special tokens may stand
        codes, known, offsets = words_of(texts, lower=not special)
        if len(self.words) + len(known) > self.most:
            self._shrink()
        where = self._places(known.cast(pa.string()))
        self.clock += 1
        self.seen[where] = self.clock
        since, until = self._spans(where)
        if end is not None:  # one more word, which ends every row
            self.ids[0] = end
            since, until = np.append(since, 0), np.append(until, 1)
            codes = np.insert(codes, offsets[1:], len(known))
            offsets = offsets + np.arange(len(offsets))
        sizes = (until - since)[codes]
        rows = np.concatenate(([0], np.cumsum(sizes)))[offsets]
        return self.ids[_ranges(since[codes], sizes)], rows


def _ranges(since: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """since[0], since[0] + 1, ... for each size, one after the other."""
    before = np.cumsum(sizes) - sizes
    out = np.repeat(since - before, sizes)
    out += np.arange(len(out))
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


@functools.cache
def word_encoder(file: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(file)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and _text in ranges of ascending doc_id; partition numbers and rows in them follow that order.

    Ties of doc_id are ordered, and if need be split, by a hash of the text. Null ids come first.
    """
    rows = docs.select("doc_id", text_of().alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    return rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

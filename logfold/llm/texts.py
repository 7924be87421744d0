"""Helpers that all text operators share: words of whole texts in numpy, and safe columns.

A word is a run without ASCII white space. Functions here work on one Arrow batch inside a task; Spark
partitions the work.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def release() -> None:
    """Give unused memory back: workers wait for their next task with what they hold, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; a longer text is a slice of its own. Memory is given back between them."""
    try:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                before = size[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(size, before + most, side="right")))
                yield batch.slice(begin, end - begin)
                begin = end
                if begin < batch.num_rows:
                    release()
    finally:
        release()


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, dictionary, offsets): row i has the words dictionary[codes[offsets[i]:offsets[i + 1]]]."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets, flat = offsets - offsets[0], lists.flatten()
    coded = flat.dictionary_encode()
    codes, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(known, pa.scalar("", known.type)).as_py()
    if empty >= 0:  # the splitter gives an empty word before leading and after trailing white space
        real = codes != empty
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return codes, known, offsets

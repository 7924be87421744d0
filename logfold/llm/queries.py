"""The registered queries of the operators; each callable takes (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.llm import bottomk, counting, descent, factors, licenses, packing, pii, rules, strata, suffixes, trie, wavelet, wordtable
from logfold.llm.texts import read


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality_rules(read(spark, folder, "documents"))


def op2_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    return factors.score(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return descent.near_vectors(read(spark, folder, "embeddings"))


def op4_wavelet_matrix(spark: SparkSession, folder: str) -> DataFrame:
    read_back = wavelet.round_trip(read(spark, folder, "documents"))
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(read(spark, folder, "documents"))


def op6_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(read(spark, folder, "documents"))


def op7_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return bottomk.near_duplicates(read(spark, folder, "documents"))


def op8_ordered_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_word_table(spark: SparkSession, folder: str) -> DataFrame:
    return wordtable.encode_decode(read(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.token_counts(read(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(read(spark, folder, "conversations"))


def op12_length_strata(spark: SparkSession, folder: str) -> DataFrame:
    return strata.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op13_suffix_merge(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_factorisation_machine, op3_nn_descent, op4_wavelet_matrix, op5_license_rules, op6_weak_supervision, op7_bottom_k,
    op8_ordered_packing, op9_word_table, op10_token_counts, op11_prefix_trie, op12_length_strata, op13_suffix_merge)}

"""Registered queries of the subpackage: ``fn(spark, folder)`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worldstate.llm import bond, bytebpe, collocations, huffman, licenses, linededup, mixing, pstable, sharding, simhash, tokencount, toxicity, vamana

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_register("op1_byte_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return bytebpe.digests(_table(spark, folder, "documents"))


@_register("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_report(_table(spark, folder, "documents"))


@_register("op2_line_dedup", linededup.LINE_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.line_report(_table(spark, folder, "documents"))


@_register("op7_pfair_mix", mixing.MIX_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_table(spark, folder, "documents"))


@_register("op9_longest_first_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_report(_table(spark, folder, "documents"))


@_register("op4_simhash_trees")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_register("op5_pstable_embeddings")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pstable.near_vectors(_table(spark, folder, "embeddings"))


@_register("op6_noisy_or_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_register("op10_license_diagonals")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(_table(spark, folder, "documents"))


@_register("op3_pruned_graph_neighbours")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return vamana.neighbour_report(_table(spark, folder, "embeddings"))


@_register("op12_bond_negatives", bond.NEGATIVE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return bond.negative_report(_table(spark, folder, "embeddings"))


@_register("op11_trie_collocations", collocations.COLLOCATION_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


@_register("op13_huffman_ids")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return huffman.id_report(_table(spark, folder, "documents"))

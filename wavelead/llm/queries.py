"""The queries of the operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelead.llm import bpe_tree
from wavelead.llm.fim import fill_in_middle, restore
from wavelead.llm.hnsw import nearest_neighbours
from wavelead.llm.host_rules import judge
from wavelead.llm.lemp import ranked_search
from wavelead.llm.near_dup import near_duplicates
from wavelead.llm.packing import pack_documents
from wavelead.llm.passages import passages
from wavelead.llm.pieces import encode_documents
from wavelead.llm.pseudo_lm import pseudo_likelihood
from wavelead.llm.quality import score_documents
from wavelead.llm.sharding import assign
from wavelead.llm.token_files import token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), piece_model(), spans=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary(), end=1, with_ids=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), host="source", keep=("doc_id",))
    return judged.withColumn("shrunk_rate", F.round("shrunk_rate", 6))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end=2)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_files": op2_token_files,
    "op3_sharding": op3_sharding,
    "op4_near_dup": op4_near_dup,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_host_rules": op6_host_rules,
    "op7_hnsw": op7_hnsw,
    "op8_passages": op8_passages,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_segment_tree_bpe": op12_segment_tree_bpe,
    "op13_ranked_search": op13_ranked_search,
}

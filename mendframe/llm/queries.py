"""The operators bound to the driver tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm import (
    embedding_dedup,
    hard_negatives,
    minhash_dedup,
    mixing,
    periodic_runs,
    pii,
    quality,
    sentencepiece_codec,
    substring_dedup,
    token_files,
    topk_search,
    url_filter,
    warc,
)
from mendframe.llm.common import shared_folder, table
from mendframe.llm.sql import HARD, MIX, NEAR_TEXTS, NEAR_VECTORS, TOPK, URLS, WARC


@dataclass(frozen=True)
class CorpusQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir)

    def oracle(self) -> str | None:
        return self.sql


QUERIES: dict[str, CorpusQuery] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = CorpusQuery(name, fn, sql)
        return fn

    return register


def tokenizer_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_spans(table(spark, sf_dir, "documents"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.digest(sentencepiece_codec.encode_decode(docs, tokenizer_file("piece_bpe_32k.model")))


@query("op4_warc", WARC)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.digest(warc.read_archives(spark, folder))


@query("op5_mixing", MIX)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=mixing.target_weights(spark)).drop("mark")


@query("op6_url_filter", URLS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("n_tried")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge_quality(table(spark, sf_dir, "documents"), columns=["doc_id"]))


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    model = tokenizer_file("word_bpe_49k.json").decode()
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, model)
    return token_files.digest(token_files.read_token_files(files, folder))


@query("op9_embedding_dedup", NEAR_VECTORS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_minhash_dedup", NEAR_TEXTS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op11_topk_search", TOPK)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"))


@query("op12_hard_negatives", HARD)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.find_runs(docs))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

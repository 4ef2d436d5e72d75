"""From raw documents to training token ids: filter, deduplicate, mask, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before;
`run` writes a stage's result as Parquet to the shared checkpoint folder and
reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm.common import shared_folder, table
from mendframe.llm.minhash_dedup import near_duplicates
from mendframe.llm.mixing import mix, target_weights
from mendframe.llm.pii import mask_personal_data
from mendframe.llm.quality import judge_quality
from mendframe.llm.queries import tokenizer_file
from mendframe.llm.sentencepiece_codec import encode_decode

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge_quality(docs).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates.

    Five-word shingles and a similarity of 0.8. Rows without doc_id stay. Texts, not ids,
    are judged: different texts with one doc_id all stay unless they are near-duplicates;
    of equal ones one row stays.
    """
    judged = near_duplicates(docs, marks=True)
    kept = judged.where("kept AND group_no IS NOT NULL")
    # Near-duplicates of each other may have the same, smallest doc_id: the first by its text's hash stays.
    first = kept.groupBy("group_no").agg(F.min("mark").alias("first_mark"))
    tied = kept.join(first, "group_no").where("mark <> first_mark")
    gone = judged.where("NOT kept").select("doc_id", "mark").unionByName(tied.select("doc_id", "mark"))
    gone = gone.select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark")).distinct()
    marked = docs.withColumn("mark", F.md5(F.coalesce(docs["text"], F.lit(""))))
    left = marked.join(gone, (F.col("doc_id") == F.col("gone")) & (F.col("mark") == F.col("gone_mark")), "left_anti")
    once = left.where("doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    return once.select("doc_id", "d.*").unionByName(left.where("doc_id IS NULL").drop("mark")).select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return mask_personal_data(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budgets of their sources' target weights: repeated once per epoch, the last one of a leaf whole."""
    chosen = mix(docs, weights=target_weights(spark)).select(F.col("doc_id").alias("__id"), "mark", "epoch").distinct()
    same = docs["doc_id"].eqNullSafe(chosen["__id"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == chosen["mark"])
    return docs.join(chosen, same).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids."""
    encoded = encode_decode(docs, tokenizer_file("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("pii", personal_data_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: The stages iterate (EM, components, pattern graph) and tokenise: no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage-{i + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

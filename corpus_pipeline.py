"""A corpus pipeline from five operators of the llm subpackage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, near_text, packing, pii, quality
from tessella.llm.common import save, table
from tessella.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores 0.5 or more, repeated ones too; null and empty texts have the score of the bias. An empty table stays empty."""
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, weights, keep=True)
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(*docs.columns)


def _row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and a long column that tells their rows apart: the id, or a new one where ids repeat or are null."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    key = "row_key"
    while key in docs.columns:
        key = "_" + key
    return save(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the largest id, of each group of equal texts; of repeated rows one. Null ids rank below all, null texts are empty ones. An empty table stays empty."""
    rows, key = _row_keys(docs)
    dropped = exact_dedup.exact_duplicates(rows, row_col=key).where("NOT kept").select(F.col("row_key").alias("dropped_key"))
    return rows.join(dropped, F.col(key) == F.col("dropped_key"), "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group whose five-word shingles are alike by 0.8 or more; null ids come last, and of one id's rows the first read stays. Null texts are empty ones. An empty table stays empty."""
    rows, key = _row_keys(docs)
    found = near_text.similar_documents(rows, id_col=key)
    if key == "doc_id":
        dropped = found.where("node <> root").select(F.col("node").alias("dropped_key"))
    else:
        ids = rows.select(F.col(key).alias("node"), F.col("doc_id").cast("long").alias("id"))
        own = save(found.join(ids, "node"), "near-groups")
        first = own.groupBy("root").agg(F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
        dropped = own.join(first, "root").where("node <> first").select(F.col("node").alias("dropped_key"))
    return rows.join(dropped, F.col(key) == F.col("dropped_key"), "left_anti").select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms, with the session's key; n_chars follows the new text. Null texts stay null."""
    return pii.pseudonymise(docs, pii.session_key(spark), keep=True).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 1024; null texts are the end id alone, and repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pseudonyms", hide_private),
    ("packing", pack_sequences),
]

#: Scores, fingerprints and tokens can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus pipeline from the training-data operators: rate, dedup, dedup near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
cluster runs them one by one, writing each result as Parquet for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import bpe, exact_dedup, jaccard_join, mixing, quality


def rate_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of the highest grade."""
    return quality.keep_good(docs, quality.label_grades(spark, sf_dir))


def drop_exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.75 or more join."""
    return jaccard_join.one_of_each(docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mixing.mixed_documents(docs)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, with a proof that they decode to its text."""
    coded = bpe.encode_and_decode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), bpe.Vocabulary(bpe.vocabulary_path()))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", rate_quality), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("mix", mix), ("encode", encode)]

#: The classifier is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

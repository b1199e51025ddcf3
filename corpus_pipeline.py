"""A corpus pipeline: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to
the shared folder and read again as the next one's docs.  All but the last keep the columns
of documents; the last gives doc_id, n_tokens and the token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op2_toxicity, op3_exact_dedup, op7_mixing, op9_byte_bpe, op10_jaccard
from tidemark.llm.shared import remove_folder, shared_folder, table

#: Near copies have this share of their five-word shingles in common.  (The op10 query's own contract is 3 words and 90 / 100.)
NEAR_WORDS, NEAR_SHARE = 5, (80, 100)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of those that came in.

    Null and empty texts stay; very long ones are judged whole; a row that repeats a doc_id,
    or has none, stays or goes by its own text; a score of exactly 0.5 counts as toxic; columns
    with any other names are kept; an empty table stays empty."""
    return op2_toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the document with the largest id stays.

    Null and empty texts are equal; rows with one id and one text are one document; other
    texts of one id, or without one, all stay; of rows without an id one stays if no other
    has the text; a very long text is compared whole, by its chunks; columns with any other
    names are kept; an empty table stays empty."""
    return op3_exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, also through others, the one with the smallest id stays.

    Null, empty and blank texts are linked with nothing and stay; texts of fewer than
    NEAR_WORDS words are linked with equal ones only; ties are decided by the text's digest;
    a row without an id stays only if no linked one has one; of rows repeated wholly one stays;
    a very long text is compared whole; columns with any other names are kept; an empty table
    stays empty."""
    return op10_jaccard.keep_one(docs, NEAR_WORDS, NEAR_SHARE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their cells' probabilities stay.

    Null sources and languages are categories of their own; texts without words weigh one
    token, very long ones are counted whole; rows that repeat a doc_id, or have none, are drawn
    together; ties don't arise, as each id has its own draw; columns with any other names are
    kept; an empty table stays empty."""
    return op7_mixing.sample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document: null and empty texts have none, repeated rows are kept.

    A very long text is encoded whole; equal texts have equal ids; other columns don't matter,
    whatever their names; an empty table gives no rows."""
    return op9_byte_bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: The fit of the first stage and the near duplicates' join can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote is deleted when the next one is through with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs

"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read again
as the documents of the next. All stages but the last return the columns of ``documents``. SQL cannot express
the learned and iterative stages, so the tests hold the stages against brute-force versions instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import bpe, jaccard_join, langid, mixing, secrets
from kelpline.session import Scratch, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected ones (null, letterless, or far from every centroid) go.
    Repeated rows and null ids are judged by their text like any other."""
    columns = docs.columns
    model = langid.learn(docs, F.lit(True))
    return langid.identify(docs, model, keep=tuple(columns)).where(~F.col("rejected")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 and more over five-word shingles: the least id, one
    row of an id. Rows without an id stay, as do documents without words, which link with nothing."""
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; ``n_chars`` follows the new text. Null and empty texts stay as
    they are; repeated rows are masked alike."""
    columns = docs.columns
    masked = secrets.redact(docs)
    if "n_chars" in columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per pass of a document, in order of training; documents are taken whole. Null texts and texts without
    words have no place in training and go; null sources are one source; repeated rows each have their passes."""
    return mixing.training_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids and the text decoded from them; null and empty texts have no ids and an empty text."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        coded = bpe.encode_decode(docs, file.read(), block_bytes=4 << 20)  # ids and whole texts leave a block at once
    return coded.select("doc_id", "n_tokens", "ids", F.decode("decoded", "utf-8").alias("text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``. Each stage is stored in the cluster's shared folder until the next
    one is, the last one until the application ends."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    scratch.drop_at_exit()
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if number:
            scratch.remove(number)
    return docs

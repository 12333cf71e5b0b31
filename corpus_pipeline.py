"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockcast.llm import content_sort, mixing, pieces, quality, simhash
from stockcast.llm.common import cut, drop

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labels that are not held out."""
    net = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, net)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return content_sort.drop_exact_copies(docs, largest=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, words=3, bits=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of smaller sources are repeated up to 1.5 times on average."""
    return mixing.mixed(docs, repetition=1.5)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns without the text, and the text's piece numbers as ``ids``, or ``piece_ids`` and so on if a column has that name."""
    name, taken = "ids", {c.lower() for c in docs.columns}
    while name in taken:
        name = f"piece_{name}"
    return pieces.encoded(docs, MODEL, keep_text=False).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "text"], F.col("ids").alias(name))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: a trained classifier and a trie walk can't be told in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is removed once the next one has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, path = cut(stage(spark, docs, sf_dir))
        if last:
            drop(spark, last)
        last = path
    return docs

"""A training corpus from documents: toxic ones out, copies out, personal data masked, sources mixed, pieces encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. What it returns is written as
Parquet and read again, so a lost executor never costs more than the stage at work.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import mixing, neardup, pieces, pii, toxicity
from gradeloom.llm.common import read, stored
from gradeloom.llm.queries import PIECE_VOCABULARY
from gradeloom.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded sample of labelled ones, does not call toxic."""
    ship_package()
    return toxicity.without_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five words and a similarity of 0.8."""
    ship_package()
    return neardup.one_of_each(docs, neardup.Likeness(5, 80))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.masked(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time, in training order."""
    return mixing.training_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, ids)`` of each row, in the order given."""
    ship_package()
    encoded = pieces.encode(docs, public_tokenizers.path(PIECE_VOCABULARY))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express the fitted classifier or the piece search; tests hold each stage against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

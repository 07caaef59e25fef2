"""The registered queries of this package, over the given tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import hardneg, idfiles, licenses, merkle, mixing, neardup, neighbours, packing, pieces, pii, quality, tokens, toxicity
from gradeloom.llm.common import read
from gradeloom.session import ship_package

WORD_VOCABULARY, PIECE_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"
REGISTRY = {}


def query(plan):
    """Register ``plan(spark, sf_dir)`` under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package()
        return plan(spark, sf_dir)

    REGISTRY[plan.__name__] = run
    return plan


@query
def op1_token_counts(spark, sf_dir):
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


@query
def op2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_mix_sources(spark, sf_dir):
    mixed = mixing.mix(mixing.document_sizes(read(spark, sf_dir, "documents")))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9)
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position")
    )


@query
def op4_permutation_index(spark, sf_dir):
    return neighbours.search(read(spark, sf_dir, "embeddings"))


@query
def op5_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op6_personal_data(spark, sf_dir):
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query
def op7_quality_fertility(spark, sf_dir):
    vocabularies = [public_tokenizers.path(v) for v in (PIECE_VOCABULARY, BYTE_VOCABULARY)]
    return quality.quality(read(spark, sf_dir, "documents"), *vocabularies)


@query
def op8_id_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return idfiles.read(idfiles.write(docs, public_tokenizers.path(WORD_VOCABULARY), end_id=1))


@query
def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op10_pieces(spark, sf_dir):
    return pieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


@query
def op11_merkle_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.lowered_fifth(docs))


@query
def op12_genetic_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), end_id=0)


@query
def op13_hard_negatives(spark, sf_dir):
    return hardneg.mine(read(spark, sf_dir, "embeddings"))

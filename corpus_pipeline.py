"""A corpus from raw documents to packed sequences: each stage is one operator over all its predecessor kept.

Defined results. Null and empty texts: scored by the classifier like any, kept by the join, left by the secret scan, of
size 0 in the mix, packed as the end token. Very long texts are worked whole in every stage. Null ids pass every stage;
the join leaves such rows. Repeated rows: the join leaves one; rows of one id with different texts are decided by
themselves, in the mix together. Ties: the join keeps the smallest id, then the smallest set, then the first row by its
JSON. Empty documents give empty tables. Extra columns pass the first four stages whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import jaccard_join, mixing, packing, quality_mil, secret_scan
from threadloom.llm.common import read, stage
from threadloom.llm.queries import tokenizer_json


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5 go."""
    return quality_mil.keep_mask(docs, quality_mil.train(docs, read(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays."""
    return jaccard_join.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redact(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated as the mix takes them."""
    return mixing.materialise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence."""
    return packing.concat_and_cut(docs, tokenizer_json())


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", ngram_jaccard_join), ("secret scans", secret_scans), ("mixing sources to target weights", mixing_to_weights), ("packing", packed)]

#: SQL expresses none of the trained or packed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

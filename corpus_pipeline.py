"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Toxic documents go, then exact and near copies; what is left is mixed to the sources' target weights, a
document standing in the mix as often as it is taken, and encoded into token ids. All stages but the last
return the columns of ``documents`` (and any further ones their input has).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tuneloom.llm import exact, mixing, similar, toxicity
from tuneloom.llm.common import stored
from tuneloom.llm.queries import byte_bpe, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("score < 0.5").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 or more of their five-word shingles, the one with the smallest id.

    SimHash fingerprints and BK-trees find what is nearest, a join by shared shingles what they miss.
    """
    return similar.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` (little-endian unsigned 32-bit) of each row, and whether they decode to its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    coded = docs.select("doc_id", "source", F.encode(text, "UTF-8").alias("bytes"), byte_bpe(spark).round_trip(text).alias("trip"))
    coded = coded.select("doc_id", "source", "bytes", "trip.*")
    whole = F.col("decoded") == F.col("bytes")
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", whole.alias("decodes"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("pareto_mix", mix_sources),
    ("byte_level_bpe", encode),
]

#: The fitted toxicity model, fingerprints and token ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

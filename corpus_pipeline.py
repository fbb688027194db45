"""A corpus from raw documents to packed sequences, in stages that are stored one after the other.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a frame
with the columns of `documents`; the last returns packed pieces. `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspc.llm import languages, line_dedup, mixing, near_copies, packing
from fleetspc.llm.queries import tokenizer_path
from fleetspc.sources.workspace import materialize

# A document is rejected if its text is like no language it could be in: likeness of its n-grams'
# ranks to the nearest profile, far below what prose of any length has.
LEAST_LIKE = 0.05

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters or like no language go."""
    profiles = languages.learn_profiles(docs)
    predicted = languages.predict_languages(docs, profiles)
    known = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_LIKE)
    return predicted.where(known).select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier; documents that consist of such lines go."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.drop_near_copies(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice stands twice."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near copies", without_near_copies),
    ("mixture", mixture),
    ("packing", packed),
]

# Language profiles, signatures and token ids are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", compression="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline over `documents`: language ID, near-duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import langid, minhash, packing, pii
from voxelframe.llm.common import col, read_table, stage, tokenizer_file, unused
from voxelframe.llm.queries import PII_KEY, held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or a letter in it go (`und`), and those without evidence for any language (score 0).

    If no document to learn from has a language, nothing can be told of any, and only those without a letter go.
    """
    model = langid.train(docs.where(~held_out()), key=F.col("doc_id"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = unused(docs.columns, "lang_pred", "score")
    judged = langid.identify(docs, model, lang_col=lang, score_col=score)
    kept = judged.where((F.col(lang) != "und") & (F.col(score) > 0)).drop(lang, score)
    return stage(kept, records=250, megabytes=2)  # written here: whoever writes it later may let texts of 10,000 rows into one Arrow batch


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words a shingle, similarity 0.8 or more."""
    return minhash.deduplicate(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its entities replaced by surrogates; n_chars follows the text."""
    entities, = unused(docs.columns, "entities")
    out = pii.pseudonymize(docs, spark.conf.get(PII_KEY, "test key"), entities_col=entities)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row per piece with its ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs


ORACLE_SQL = None

"""The corpus pipeline: each stage works on all that its predecessor kept and returns documents.

Stages carry the other columns of documents along as they are; ``n_chars`` follows the text where a stage shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import language_id
from vicinal.llm.common import WORD, read, table
from vicinal.llm.decontaminate import decontaminate
from vicinal.llm.line_dedup import dedup_lines
from vicinal.llm.mixing import mix
from vicinal.llm.near_dups import near_duplicates


def _packed(docs: DataFrame) -> DataFrame:
    """The columns the operators use, and one struct with all of them."""
    used = [c for c in ("doc_id", "text", "source", "lang") if c in docs.columns]
    return docs.select(*used, F.struct(*docs.columns).alias("carried"))


def _unpacked(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as they were, with the new text and its length."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return docs.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized."""
    return language_id.accepted(docs, language_id.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go; a document of which no word is left goes with them."""
    found = dedup_lines(_packed(docs), "carried")
    return _unpacked(found.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)), docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least doc_id."""
    gone = table(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    small = gone.count() <= 1_000_000
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the benchmark's words go."""
    return _unpacked(decontaminate(_packed(docs), read(spark, sf_dir, "benchmark"), "carried"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample by calibrated probabilities, with them as ``probability`` (under a free name if that is taken)."""
    drawn = mix(_packed(docs), "carried", bounded=True).where("sampled")
    name = "probability"
    while name in docs.columns:
        name += "_"
    return drawn.select(*[F.col("carried")[c].alias(c) for c in docs.columns], F.col("probability").alias(name))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dups", near_dups), ("clean_benchmark", clean_benchmark), ("mixing", mixing)]

#: Language identification is a trained model, which SQL cannot express; tests hold the stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs

"""The registered queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, quality_rules, secrets, token_counts, toxicity
from ..sources.shared import scratch
from .common import read, semi
from .line_dedup import dedup_lines
from .mixing import mix
from .near_dups import near_duplicates
from .repeats import remove_repeats
from .sql import ORACLES  # noqa: F401  the entry module takes it from here


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    held_out = F.coalesce(language_id.remainder(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, the first two of them sent twice: all documents come; those labelled of low quality go;
    those labelled toxic are revised to their distinct lines."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ledger = token_counts.Ledger(spark, scratch(spark, "ledger"), token_counts.version(token_counts.FOLDER, token_counts.VOCABULARY))
    marked = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    come = docs.withColumn("op", F.lit("insert"))
    gone = semi(docs.select("doc_id", "source", "lang"), marked.where("q = 0").select("doc_id"), "doc_id").withColumns({"op": F.lit("delete"), "text": F.lit(None).cast("string")})
    lines = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    new = semi(docs, marked.where("q = 1 and t = 1").select("doc_id"), "doc_id").withColumns({"op": F.lit("revise"), "text": lines})
    for batch, changes in (("1-come", come), ("2-gone", gone), ("1-come", come), ("3-revised", new), ("2-gone", gone)):
        ledger.apply(batch, token_counts.count_tokens(changes))
    return ledger.totals()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.withColumn("probability", F.round("probability", 9))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.array_join("failed", ",").alias("failed_rules"), "certified", "kept")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(spans, s -> s.kind < 3)"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.text_of(F.col("base")), 256).alias("base_sha256"), secrets.text_of(F.col("spans")).alias("spans"))


def op8_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_rollup": op3_token_rollup,
    "op4_toxicity": op4_toxicity,
    "op5_mix_sources": op5_mix_sources,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_minhash_near_dups": op8_minhash_near_dups,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_dedup": op10_line_dedup,
}

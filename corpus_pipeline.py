"""A training corpus from ``documents``: the operators in a row, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import bpe, decontaminate, lines, ngram_join, quality
from leadloom.llm.common import table, written
from leadloom.llm.fingerprint import bound
from leadloom.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from this stage's own input, do not reject."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(bound(quality.statistics(F.col("text")), rules.score) >= quality.THRESHOLD)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents; n_chars follows the text."""
    rows = lines.without_recurring_lines(docs, counted_as="_dropped")
    n_chars = F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).drop("_dropped") if "n_chars" in docs.columns else rows.drop("_dropped")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal sets of word shingles, directly or in a chain, the one with the least id. Rows with one id stay or go together."""
    stays = ngram_join.linked_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_stays"]), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from them."""
    tables = bpe.tokenizer(spark, TOKENIZER)
    return bpe.decode(bpe.encode(docs, tables), tables).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality_rules", keep_good), ("line_templates", drop_recurring_lines), ("ngram_groups", keep_one_of_each_group),
    ("decontamination", drop_contaminated), ("bpe_tokens", tokenize),
]
# Learned rules, a match within an edit distance and BPE are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

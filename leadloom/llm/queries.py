"""The operators as registered queries over the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import bpe, decontaminate, fim, fingerprint, langid, licenses, lines, ngram_join, periodic, quality, rollup, suffix_dedup, warc
from leadloom.llm.common import shared_folder, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = suffix_dedup.without_repeats(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and round trip of every document."""
    tables = bpe.tokenizer(spark, TOKENIZER)
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf, "documents"), tables), tables))


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as it is read back from the written archives."""
    pages = warc.records(table(spark, sf, "pages"))
    path = shared_folder(spark)
    warc.write_archives(pages, warc.resolve(pages), path)
    read = warc.rejoin(warc.read_archives(spark, path))
    return read.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id != original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id != original THEN original END AS refers_to
FROM m
"""


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its distance."""
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def token_changes(docs: DataFrame, version: str) -> DataFrame:
    """Inserts of all documents under a tokenizer version: white-space words, or UTF-8 bytes."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    n = {"words-1": words, "bytes-1": F.octet_length(text), "words-2": words + 1}[version]
    return docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), n.cast("long").alias("n_tokens"), "n_chars")


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after four batches: all documents under two versions; texts under 100 characters deleted; the words of long texts counted
    anew, with an end mark; the deletions sent a second time, which changes nothing."""
    docs = table(spark, sf, "documents")
    ledger = shared_folder(spark)
    words, by_bytes = token_changes(docs, "words-1"), token_changes(docs, "bytes-1")
    inserts = words.unionByName(by_bytes)
    deletes = inserts.filter("n_chars < 100").withColumn("op", F.lit("delete"))
    revised = token_changes(docs, "words-2").filter("n_chars >= 5000").withColumns(
        {"op": F.lit("revise"), "old_n_tokens": F.col("n_tokens") - 1, "old_tokenizer_version": F.lit("words-1")}
    )
    for batch, changes in (("load", inserts), ("deletions", deletes), ("recount", revised), ("deletions", deletes)):
        rollup.commit(changes, ledger, batch)
    rollup.compact(spark, ledger)
    return rollup.totals(spark, ledger)


OP5 = r"""
WITH d AS (SELECT source, lang, n_chars, strlen(coalesce(text, '')) AS b, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents),
r AS (
  SELECT source, lang, 'bytes-1' AS tokenizer_version, b AS n FROM d WHERE n_chars IS NULL OR n_chars >= 100
  UNION ALL SELECT source, lang, 'words-1', w FROM d WHERE n_chars IS NULL OR n_chars >= 100 AND n_chars < 5000
  UNION ALL SELECT source, lang, 'words-2', w + 1 FROM d WHERE n_chars >= 5000)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM r GROUP BY ALL
"""


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rules = quality.learn(docs, table(spark, sf, "labels"))
    rows = quality.scored(docs, rules)
    return rows.select("doc_id", (quality.fold() == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and dropped lines of every document, and the digest of what is left."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"))
    rows = lines.without_recurring_lines(docs, counted_as="n_dropped")
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf, "documents"))


def op9_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.linked_groups(table(spark, sf, "documents"))


def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = langid.fold("doc_id", 4) == 2
    tables = langid.learn(docs.filter(~held))
    return langid.predict(docs, tables).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Every text cut at line ends, and the text rebuilt from the output."""
    rows = fim.fill_in_middle(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of every document, a tenth of which get words that repeat."""
    rows = periodic.periodic_runs(periodic.with_planted_repeats(table(spark, sf, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = rows.withColumn("best", periodic.strongest(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases and licence notices of every document."""
    rows = licenses.scan(table(spark, sf, "documents"))
    joined = lambda *labels: F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")
    starts, base, spans = F.col("phrases.start"), F.col("phrases.label"), F.col("spans.label")
    return rows.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(base, spans).alias("labels"), "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_warc, op4_decontaminate, op5_token_counts, op6_quality, op7_line_dedup, op8_fingerprints, op9_ngram_join, op10_language,
                              op11_fill_in_middle, op12_periodic_runs, op13_license_scan)
}
ORACLE: dict[str, str] = {"op3_warc": OP3, "op5_token_counts": OP5, "op7_line_dedup": lines.ORACLE, "op8_fingerprints": fingerprint.ORACLE, "op11_fill_in_middle": fim.ORACLE}

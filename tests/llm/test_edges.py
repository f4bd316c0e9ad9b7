"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import bpe, decontaminate, fingerprint, langid, lines, ngram_join, quality, rollup, suffix_dedup, warc
from leadloom.llm.common import shared_folder

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EXTRA = ("n", "key", "set", "line", "leaf", "score", "ids", "place", "piece", "words", "wanted", "spans", "block", "label", "s", "edited", "hash", "_gone", "_found")
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, LONG, "en", None), (5, "One line only here.", "en", "b"), (5, "One line only here.", "en", "b"),
    (None, "no id at all, but text", "en", "b"), (6, "é" * 300, "fr", "b"), (7, "7 8 9\n\n\n", "de", "c"), (8, LONG[:5000], "en", "c"), (9, "One line only here.", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    df = spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA).repartition(3)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def size(docs):
    return docs.count()


def test_suffix(docs, size):
    rows = suffix_dedup.without_repeats(docs).collect()
    assert len(rows) == size
    by_id = {r["doc_id"]: r for r in rows}
    if size:
        assert by_id[1]["n_bytes"] == 0 == by_id[2]["n_removed"] and by_id[8]["n_removed"] == 5000 and by_id[6]["n_removed"] > 0
        assert by_id[5]["n_removed"] == 0  # shorter than a string


def test_bpe(spark, docs, size):
    from leadloom.llm.queries import TOKENIZER

    tables = bpe.tokenizer(spark, TOKENIZER)
    rows = bpe.digests(bpe.decode(bpe.encode(docs, tables), tables)).collect()
    assert len(rows) == size
    for r in rows:
        if r["doc_id"] in (1, 2):
            assert r["n_tokens"] == 0 and r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_warc(spark, docs, size):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b\r\nc d").alias("url"), F.col("text").alias("html"), "key", "n")
    rows = warc.records(pages)
    path = shared_folder(spark)
    warc.write_archives(rows, warc.resolve(rows, 10), path)
    read = warc.rejoin(warc.read_archives(spark, path)).collect() if size else []
    assert len(read) == size
    if size:
        kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in read}
        assert ("5", "revisit", "9") in kinds and ("9", "response", None) in kinds and (None, "response", None) in kinds and ("1", "response", None) in kinds


def test_decontaminate(spark, docs, size):
    items = spark.createDataFrame([(1, "one LINE, only here"), (2, None), (3, ""), (None, "word1 word2 word3 word4"), (4, "word5"), (1, "one LINE, only here")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == ({(5, 1), (9, 1), (4, None), (8, None), (4, 4), (8, 4)} if size else set())
    assert decontaminate.clean(docs, items).count() == (size and 6)
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_rollup(spark, docs, size):
    changes = docs.select(F.lit("insert").alias("op"), "source", "lang", F.lit("v").alias("tokenizer_version"), F.length("text").alias("n_tokens"))
    ledger = shared_folder(spark)
    assert rollup.totals(spark, ledger).count() == 0
    assert rollup.commit(changes, ledger, "a")
    rows = rollup.totals(spark, ledger).collect()
    assert sum(r["n_docs"] for r in rows) == size
    assert not size or any(r["source"] is None and r["lang"] is None and r["n_tokens"] == 0 for r in rows)


def test_rollup_refuses_the_names_of_compactions(spark, docs):
    changes = docs.select(F.lit("insert").alias("op"), "source", "lang", F.lit("v").alias("tokenizer_version"), F.length("text").alias("n_tokens"))
    for name in ("compact-1", "compact-", "compact-x", "", "a/b"):
        with pytest.raises(ValueError):
            rollup.commit(changes, shared_folder(spark), name)


@pytest.mark.parametrize("labels", [[], [(4, 1, 0), (6, None, 0), (None, 1, 1)], [(4, 1, 0), (4, 0, 0), (7, 0, 1), (8, 1, 0), (999, 1, 0)]])
def test_quality(spark, docs, size, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.learn(docs, marks, trees=3)).collect()
    assert len(rows) == size and all(0 <= r["score"] <= 1 for r in rows)


def test_lines(docs, size):
    out = lines.without_recurring_lines(docs, counted_as="dropped")
    assert out.columns == [*docs.columns, "dropped"]
    rows = out.collect()
    assert len(rows) == size and all(r["text"] is None for r in rows if r["doc_id"] == 1)


def test_fingerprints(docs, size):
    rows = fingerprint.fingerprints(docs).collect()
    assert len(rows) == size
    by_id = {r["doc_id"]: r for r in rows}
    if size:
        assert by_id[1]["fingerprint"] == "" and by_id[1]["near_next"] == 1.0 and by_id[5]["fingerprint"] == by_id[9]["fingerprint"] != ""
        assert by_id[2]["near_next"] == 1.0 and by_id[3]["near_next"] == 0.0  # 3 has no word, 4 has


def test_groups(docs, size):
    rows = ngram_join.linked_groups(docs).collect()
    assert len(rows) == size
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    if size:
        assert by_id[1] == (0, 1) and by_id[3] == (0, 3) and by_id[5] == (1, 5) == by_id[9] and by_id[4] == (977, 4)


def test_language(docs, size):
    rows = langid.predict(docs, langid.learn(docs)).collect()
    assert len(rows) == size
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 7))
    assert not size or next(r for r in rows if r["doc_id"] == 4)["lang_pred"] == "en"
    assert all(r["lang_pred"] == "und" for r in langid.predict(docs, langid.learn(docs.limit(0))).collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, size, name, stage):
    out = stage(spark, docs, "/root/testdata/sf0.001")
    n = out.count()
    assert n <= size and (name == "bpe_tokens" or out.columns == docs.columns)
    if name in ("line_templates", "bpe_tokens"):
        assert n == size
    if name == "ngram_groups":
        assert n == (size and size - 1)

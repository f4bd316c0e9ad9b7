"""Language of a text: known words by per-language log frequency, unseen words by ever shorter character n-grams.

``learn`` counts words of labelled texts in Spark and keeps a table of bounded size: the most frequent words of each language, and the
most frequent n-grams of each length, with their counts in every language. ``predict`` is one narrow pass: a known word adds its log probability in each language; an unseen
word adds the mean, over its positions, of the longest known n-gram there (lengths ``LONGEST`` down to 1).

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language first in order. Rows are judged one by one, so repeated
rows and extra columns change nothing. With no labelled row every text is ``und``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.common import built

LONGEST = 5
CACHED = 1 << 18


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def learn(labelled: DataFrame, docs_per_language: int = 4000, words_per_language: int = 20_000, grams_per_length: int = 5_000) -> dict:
    """Tables from (doc_id, text, lang). Learns from about ``docs_per_language`` texts of each language, taken by a hash of the id;
    holds at most ``words_per_language + LONGEST * grams_per_length`` entries a language."""
    rows = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"languages": [], "words": {}, "grams": {}}
    shares = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < shares[F.col("lang")] * 1_000_003
    words = (
        rows.filter(taken)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = words.withColumn("at", F.row_number().over(best)).withColumn("at", F.min("at").over(Window.partitionBy("word"))).filter(F.col("at") <= words_per_language)
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    starts = F.sequence(F.lit(1), F.length("padded"))
    grams = words.withColumn("padded", padded).select(
        "lang", "n", F.explode(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.col("padded").substr(i, k)))))).alias("gram")
    )
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("k", F.length("gram"))
    best = Window.partitionBy("lang", "k").orderBy(F.desc("n"), "gram")
    short = grams.withColumn("at", F.row_number().over(best)).withColumn("at", F.min("at").over(Window.partitionBy("gram"))).filter(F.col("at") <= grams_per_length)
    languages = sorted(sizes)
    at = {lang: i for i, lang in enumerate(languages)}

    def logs(counted) -> dict[str, np.ndarray]:
        counts: dict[str, np.ndarray] = {}
        for key, lang, n in counted:
            counts.setdefault(key, np.zeros(len(languages)))[at[lang]] = n
        total = sum(counts.values(), np.zeros(len(languages))) + 0.5 * len(counts)
        return {key: np.log((n + 0.5) / total).astype(np.float32) for key, n in counts.items()}

    tables = {"languages": languages, "words": logs(top.select("word", "lang", "n").toLocalIterator()), "grams": {}}
    counted = short.select("gram", "lang", "n", "k").collect()
    for k in range(1, LONGEST + 1):
        tables["grams"] |= logs((r["gram"], r["lang"], r["n"]) for r in counted if r["k"] == k)
    words.unpersist()
    return tables


class Scorer:
    """One per Python worker."""

    def __init__(self, tables: dict):
        self.languages = tables["languages"]
        entries = [*tables["words"].values(), *tables["grams"].values()]
        self.logs = np.array(entries, np.float64).reshape(len(entries), len(self.languages))
        self.words = {w: i for i, w in enumerate(tables["words"])}
        self.grams = {g: i + len(self.words) for i, g in enumerate(tables["grams"])}
        self.letters = regex.compile(r"\p{L}+")
        self.unseen: dict[str, list[int]] = {}

    def backoff(self, word: str) -> list[int]:
        found = self.unseen.get(word)
        if found is None:
            padded, grams = f"^{word}$", self.grams
            found = []
            for i in range(len(padded)):
                for k in range(LONGEST, 0, -1):
                    hit = grams.get(padded[i : i + k])
                    if hit is not None:
                        found.append(hit)
                        break
            if len(word) <= 64:
                if len(self.unseen) >= CACHED:
                    self.unseen.clear()
                self.unseen[word] = found
        return found

    def judge(self, text: str | None) -> tuple[str, float]:
        counts = Counter(self.letters.findall(text.lower())) if text else None
        if not counts or not self.languages:
            return "und", 0.0
        at, weights = [], []
        for word, n in counts.items():
            known = self.words.get(word)
            if known is not None:
                at.append(known)
                weights.append(n)
            elif found := self.backoff(word):
                at += found
                weights += [n / len(found)] * len(found)
        total = np.array(weights) @ self.logs[at] if at else np.zeros(len(self.languages))
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


_scorers: dict[int, tuple[dict, Scorer]] = {}


def predict(docs: DataFrame, tables: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per row of ``docs``; score is the posterior of the prediction under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        own = built(_scorers, shared.value, Scorer)
        for batch in batches:
            judged = [own.judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in judged], pa.string()), pa.array([x[1] for x in judged], pa.float64())], names=[id_col, "lang_pred", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")

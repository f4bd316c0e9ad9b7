"""Quality of a text by an ensemble of sparse rules.

Statistics of the text (column expressions) are cut by a forest of shallow trees; every path from a root to a node is a rule, a
conjunction of thresholds. A logistic regression with an L1 penalty weighs the rules and drops most. The rules left are compiled into one
column expression, so that scoring is a narrow pass without Python.

Learns from a bounded sample: about ``SAMPLE`` labelled texts, taken by a hash of the id. Null texts count as empty and get a score like any
other. With labels of one class only, or none, the score is the share of label 1 (0.5 without labels). Rows are scored one by one:
repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.fingerprint import bound

SAMPLE = 6000
THRESHOLD = 0.3


def statistics(text: Column) -> Column:
    """A struct of numbers that describe the whole text; 0 where there is nothing to divide by."""

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    def count(t, signs):
        return F.length(t) - F.length(F.translate(t, signs, ""))

    def of(t):
        n = F.length(t)
        return bound(F.struct(F.filter(F.split(t, r"\s+"), lambda x: x != "").alias("words"), F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("lines")), lambda s: numbers(t, n, s))

    def numbers(t, n, s):
        words, lines = s["words"], s["lines"]
        k, m = F.size(words), F.size(lines)
        values = {
            "log_chars": F.log1p(n), "log_words": F.log1p(k), "log_lines": F.log1p(m),
            "word_length": share(n, k), "line_length": share(n, m), "lines_per_word": share(m, k),
            "digits": share(count(t, "0123456789"), n), "symbols": share(count(t, "#$%&*+=@^_~\\/"), n), "brackets": share(count(t, "<>{}[]()"), n), "bars": share(count(t, "|"), n),
            "stops": share(count(t, ".;:"), k), "commas": share(count(t, ","), k), "shouts": share(count(t, "!?"), k), "quotes": share(count(t, "\"'`"), n),
            "upper": share(F.regexp_count(t, F.lit(r"\p{Lu}")), n), "lower": share(F.regexp_count(t, F.lit(r"\p{Ll}")), n), "blanks": share(count(t, " \t\n\r"), n),
            "distinct_words": share(F.size(F.array_distinct(words)), k), "distinct_lines": share(F.size(F.array_distinct(lines)), m),
            "short_words": share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), k), "long_words": share(F.size(F.filter(words, lambda w: F.length(w) >= 14)), k),
            "longest_word": F.log1p(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))),
            "ended_lines": share(F.size(F.filter(lines, lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", ":"))), m),
            "links": share(F.regexp_count(t, F.lit(r"https?://|www\.")), k),
        }
        return F.struct(*[v.cast("double").alias(name) for name, v in values.items()])

    return bound(F.coalesce(text.cast("string"), F.lit("")), of)


def fold(folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def _paths(node, path=()):
    """Every path from the root of a tree to one of its nodes, as ((feature, is_left, threshold), ...)."""
    if path:
        yield path
    if node.subtreeDepth():
        split = node.split()
        at, cut = split.featureIndex(), split.threshold()
        yield from _paths(node.leftChild(), (*path, (at, True, cut)))
        yield from _paths(node.rightChild(), (*path, (at, False, cut)))


def _holds(rule, value) -> Column:
    held = F.lit(True)
    for at, is_left, cut in rule:
        held = held & ((value(at) <= cut) if is_left else (value(at) > cut))
    return held


class Rules:
    """(rule, weight) pairs over named statistics, and an intercept."""

    def __init__(self, names: list[str], rules: list[tuple[tuple, float]], intercept: float):
        self.names, self.rules, self.intercept = names, rules, intercept

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, lambda at: stats[self.names[at]]), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> Rules:
    """Rules from ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) mark, the held-out fold left out. Repeated labels of an id count once, the larger."""
    marked = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & (fold() != 0))
    n = marked.count()
    if n:
        # two doc_id hashes in 1,000,003 parts: a share of the ids, so at most a few more rows than ``sample``
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) <= 1_000_003 * min(1.0, sample / n))
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    taken = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    names = [f.name for f in docs.sparkSession.range(1).select(statistics(F.lit("a")).alias("s")).schema["s"].dataType.fields]
    rows = taken.select(statistics(F.col("text")).alias("s"), "label").select("label", *[F.col(f"s.{x}").alias(x) for x in names]).persist()
    ones = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not ones["n"] or ones["ones"] in (0, ones["n"]):
        rows.unpersist()
        p = ones["ones"] / ones["n"] if ones["n"] else 0.5
        return Rules(names, [], math.log((p + 1e-6) / (1 - p + 1e-6)))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=48, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted({p for tree in forest.trees for p in _paths(tree._call_java("rootNode"))})
    held = [_holds(r, lambda at: F.col(names[at])).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    tested = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(rows.select("label", *held)).select("label", "features")
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(tested)
    rows.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return Rules(names, [(r, w) for r, w in zip(rules, weights) if w], float(lasso.intercept))


def scored(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` added (an input column of that name is replaced)."""
    kept = [c for c in docs.columns if c not in ("score", "_stats")]
    return docs.select(*kept, statistics(F.col(text_col)).alias("_stats")).select(*kept, rules.score(F.col("_stats")).alias("score"))

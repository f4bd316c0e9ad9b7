"""Fingerprints that keep every shingle hash below a fixed fraction of the hash range.

A sketch is the sorted set of the MD5 prefixes, of word shingles, that lie below ``fraction``; a text whose shingles all lie above keeps its
smallest one, so that only texts without a word have an empty sketch. Because the threshold is the same for every
text, the sketch of a union is the union of sketches (``merged``), and what a short text shares with a very long one
is estimated without bias (``containment``).

Null and empty texts have an empty sketch; two empty sketches have likeness 1, an empty and another one 0. Texts with fewer than ``SHINGLE`` words
are one shingle. Everything is a column expression of one row, apart from ``with_next``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE = 5
SIXTEENTHS = 4
PREFIX = 16
LOWEST = -(2**63)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(r"([^\x20\x09-\x0D]+)"))


def sketch(text: Column, sixteenths: int = SIXTEENTHS) -> Column:
    """array<string>: the retained hashes in order; ``sixteenths`` of 16 parts of the hash range are kept."""

    def hashes(w):
        starts = F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))
        many = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, SHINGLE), " ").cast("binary")), 1, PREFIX))
        one = F.array(F.substring(F.md5(F.array_join(w, " ").cast("binary")), 1, PREFIX))
        return F.when(F.size(w) >= SHINGLE, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<string>"))

    def retained(h):
        below = F.filter(h, lambda x: x < f"{sixteenths:x}") if sixteenths < 16 else h
        return bound(below, lambda b: F.when((F.size(b) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(F.array_sort(F.array_distinct(b))))

    return bound(words(text), lambda w: bound(hashes(w), retained))


def merged(a: Column, b: Column, sixteenths: int = SIXTEENTHS) -> Column:
    """Sketch of the shingles of both."""
    both = F.array_sort(F.array_union(a, b))
    return bound(both, lambda x: bound(F.filter(x, lambda h: h < f"{sixteenths:x}") if sixteenths < 16 else x, lambda y: F.when(F.size(y) > 0, y).otherwise(F.slice(x, 1, 1))))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` holds."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(shared / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller in the larger."""
    return F.when(F.size(a) <= F.size(b), containment(a, b)).otherwise(containment(b, a))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each text with that of the next document by (doc_id, text); the last is followed by the first. A null id comes first.

    Ids are dealt into ranges of 1,024 and each range is put in order by itself, so no task sees more than that many ids; only the first
    text of each range travels to the range before it, found over ranges and ranges of ranges.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.shiftright(key, 10).alias("block")).repartition("block")
    firsts = rows.groupBy("block").agg(F.min_by("text", F.struct("doc_id", "text")).alias("first_text")).withColumn("region", F.shiftright("block", 20))
    regions = firsts.groupBy("region").agg(F.min_by("first_text", "block").alias("first_text"))
    order = Window.orderBy("region")  # a row per 2**30 ids
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    regions = regions.select("region", F.coalesce(F.lead("first_text").over(order), F.first("first_text").over(whole)).alias("after_region"))
    blocks = firsts.join(regions, "region").select(
        "block", F.coalesce(F.lead("first_text").over(Window.partitionBy("region").orderBy("block")), F.col("after_region")).alias("after_block")
    )
    own = Window.partitionBy("block").orderBy("doc_id", "text")
    return rows.withColumn("in_block", F.lead("text").over(own)).join(blocks, "block").select("doc_id", "text", F.coalesce("in_block", "after_block").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by the beginning of ``following``, as many code points or all there are."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its sketch, that of its edited text, and their likeness and that to the next document's."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("e"), sketch(F.col("next_text")).alias("n"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("a", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("n")).alias("near_next"),
    )


LETTERS = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"


def _sql_sketch(text: str) -> str:
    w = rf"regexp_extract_all(translate({text}, {LETTERS}), '[^\x20\x09-\x0D]+')"
    many = f"list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: substr(md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')), 1, {PREFIX}))"
    one = f"[substr(md5(array_to_string(w, ' ')), 1, {PREFIX})]"
    below = f"list_filter(h, lambda x: x < '{SIXTEENTHS:x}')"
    return (
        f"(SELECT CASE WHEN len(h) > 0 AND len({below}) = 0 THEN [list_min(h)] ELSE list_sort(list_distinct({below})) END FROM "
        f"(SELECT CASE WHEN len(w) >= {SHINGLE} THEN {many} WHEN len(w) > 0 THEN {one} ELSE [] END AS h FROM (SELECT {w} AS w)))"
    )


def _sql_likeness(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared} END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text),
        first_value(text) OVER (ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS following FROM d),
x AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2) AS edited FROM n),
s AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
        {_sql_sketch('x.text')} AS a, {_sql_sketch('x.edited')} AS e, {_sql_sketch('x.following')} AS n FROM x)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
       {_sql_likeness('a', 'e')} AS near_edited, {_sql_likeness('a', 'n')} AS near_next FROM s
"""

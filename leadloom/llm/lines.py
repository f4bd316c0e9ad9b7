"""Lines of a recurring template are dropped.

Each line goes down a tree of fixed depth: its token count, then its first ``DEPTH`` tokens, tokens with a digit being ``<*>``. A line of up
to ``DEPTH`` tokens, and so a line without spaces, is a leaf of its own. A leaf gets a template: at each position the token that at least
half of its lines have there, else ``<*>``. Lines that equal the template's fixed tokens at ``SIMILARITY`` of their positions belong to it; any
other line is its own template.

A template recurs if its lines stand in at least ``MIN_DOCS`` = 3 documents that are unrelated in pairs. Copies must not count as recurrence, or
copied documents would lose all their lines. Two documents are related if they have more than half of their leaves in common (of the
``PROFILE`` least leaf numbers of both, so that long documents cost no more than short ones). The unrelated ones are looked for in order of
ids: the first document of the template, the first that is unrelated to it, and any that is unrelated to both.

Blank lines are kept. A null text stays null, an empty one empty. Whether a line goes depends on the line alone, so
repeated rows and rows with equal ids lose the same lines; rows without an id count as one document; all other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leadloom.llm.common import written
from leadloom.llm.fingerprint import LOWEST, bound

DEPTH, SIMILARITY, MIN_DOCS, PROFILE, RELATED = 4, 0.75, 3, 64, 0.5
TOKEN, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
FIRST = rf"^(?:{BLANK})?({TOKEN}(?:{BLANK}{TOKEN}){{0,{DEPTH - 1}}})"
FIELD = r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"


def digest(column: Column) -> Column:
    """60 bits of the MD5, as a number."""
    return F.conv(F.substring(F.md5(column.cast("binary")), 1, 15), 16, 10).cast("long")


def masked(column: Column) -> Column:
    """Tokens with a digit become the variable field."""
    return F.when(column.rlike("[0-9]"), F.regexp_replace(column, FIELD, "<*>")).otherwise(column)


def key_of(docs: DataFrame) -> Column:
    """The id without nulls, so that plain joins and groups hold all rows."""
    integral = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)) if integral else F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))


def profiles_of(docs: DataFrame) -> DataFrame:
    """(d, lines, profile) for every row: its distinct lines as (line_hash, leaf), and its least leaves; no text."""

    def of(line):
        n = F.regexp_count(line, F.lit(f"({TOKEN})"))
        first = bound(F.regexp_extract(line, FIRST, 1), masked)
        leaf = lambda n: digest(F.concat(n.cast("string"), F.lit(":"), F.regexp_replace(first, BLANK, " ")))
        return bound(n, lambda n: F.struct(digest(line).alias("line_hash"), F.when(n > 0, leaf(n)).alias("leaf")))

    def summed(lines):
        leaves = F.slice(F.array_sort(F.array_distinct(F.transform(lines, lambda x: x["leaf"]))), 1, PROFILE)
        return F.struct(lines.alias("lines"), leaves.alias("profile"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.transform(F.array_distinct(F.split(text, "\n")), of), lambda x: x["leaf"].isNotNull())
    return docs.select(key_of(docs).alias("d"), bound(lines, summed).alias("s")).select("d", "s.*")


def tokens_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_hash, tokens) of the lines in ``wanted`` (d, line_hash), read from those documents."""
    wanted = wanted.groupBy("d").agg(F.collect_set("line_hash").alias("_lines"))
    # a merge join at any size: what is wanted grows with the documents, so a broadcast would only hold for small ones
    rows = docs.select(key_of(docs).alias("d"), "text").join(wanted.hint("merge"), "d")
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.array_contains("_lines", digest(x))))
    tokens = F.regexp_extract_all(masked(F.col("line")), F.lit(f"({TOKEN})"))
    return rows.select(F.explode(lines).alias("line")).select(digest(F.col("line")).alias("line_hash"), tokens.alias("tokens")).dropDuplicates(["line_hash"])


def templates_of(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(leaf, line_hash, template) of every different line of the leaves in ``shared`` (d, leaf, line_hash)."""
    kinds = shared.groupBy("leaf", "line_hash").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    varied = kinds.groupBy("leaf").agg(F.count("*").alias("_kinds")).filter("_kinds > 1").select("leaf")
    kinds = written(kinds.join(varied.withColumn("varied", F.lit(True)), "leaf", "left"))
    counted = kinds.filter("varied")  # a leaf with one line is its own template; its tokens are not looked at
    counted = written(counted.select("leaf", "line_hash", "n", "d").join(tokens_of(docs, counted), "line_hash").select("leaf", "line_hash", "n", "tokens"))
    at = counted.select("leaf", "n", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    most = at.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("most"), F.sum("n").alias("all"))
    fixed = F.when(F.col("most.n") * 2 >= F.col("all"), F.col("most.token")).otherwise(F.lit("<*>"))
    templates = most.select("leaf", "at", fixed.alias("token")).groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"))
    same = F.size(F.filter(F.zip_with("tokens", "template", lambda a, b: a == b), lambda x: x))
    own = F.when(same >= F.size("tokens") * F.lit(SIMILARITY), F.array_join("template", " ")).otherwise(F.array_join("tokens", " "))
    placed = counted.join(templates, "leaf").select("leaf", "line_hash", digest(own).alias("template"))
    return placed.unionByName(kinds.filter("varied IS NULL").select("leaf", "line_hash", F.col("leaf").alias("template")))


def unrelated(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Those of ``pairs`` (template, d, r) whose documents have at most half of their leaves in common."""

    def apart(a, b):
        both = F.slice(F.array_sort(F.array_union(a, b)), 1, PROFILE)
        return bound(both, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) <= RELATED * F.size(u))

    ends = pairs.select("d", "r").distinct()
    first, second = profiles.select("d", F.col("profile").alias("a")), profiles.select(F.col("d").alias("r"), F.col("profile").alias("b"))
    far = ends.join(first, "d").join(second, "r").filter(apart(F.col("a"), F.col("b"))).select("d", "r")
    return pairs.join(far, ["d", "r"], "left_semi")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(d, line_hash): the distinct lines of each document that go."""
    rows = written(profiles_of(docs))
    profiles = rows.groupBy("d").agg(F.min("profile").alias("profile"))
    lines = rows.select("d", F.explode("lines").alias("x")).select("d", "x.*")
    reached = lines.groupBy("leaf").agg(F.countDistinct("d").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf")
    shared = written(lines.join(reached, "leaf", "left_semi"))
    found = written(shared.join(templates_of(docs, shared), ["leaf", "line_hash"]).select("template", "d", "line_hash"))

    members = found.select("template", "d").distinct()
    first = members.groupBy("template").agg(F.min("d").alias("r"), F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).drop("n")
    others = written(unrelated(members.join(first, "template").filter("d <> r"), profiles).select("template", "d"))
    second = others.groupBy("template").agg(F.min("d").alias("r"), F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS - 1).drop("n")
    third = unrelated(others.join(second, "template").filter("d <> r"), profiles).select("template").distinct()
    return written(found.join(third, "template", "left_semi").select("d", "line_hash").distinct())


def without_recurring_lines(docs: DataFrame, counted_as: str | None = None) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``; all columns in their order, then the number of lines taken out if ``counted_as`` names it."""
    gone = recurring_lines(docs).groupBy(F.col("d").alias("_gone_id")).agg(F.collect_set("line_hash").alias("_gone"))
    joined = docs.join(gone.hint("merge"), key_of(docs) == gone["_gone_id"], "left")
    kept = F.filter(F.split(docs["text"], "\n"), lambda x: ~F.array_contains(gone["_gone"], digest(x)))
    text = F.when(gone["_gone"].isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    n_gone = F.when(gone["_gone"].isNull(), F.lit(0)).otherwise(F.size(F.split(docs["text"], "\n")) - F.size(kept)).cast("long")
    counted = [n_gone.alias(counted_as)] if counted_as else []
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], *counted)


_APART = "len(list_filter(u, lambda x: list_contains(a, x) AND list_contains(b, x))) <= 0.5 * len(u)"
_UNION = "list_sort(list_distinct(list_concat(p.profile, q.profile)))[1:{PROFILE}] AS u, p.profile AS a, q.profile AS b"

ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(list_distinct(ls)) AS line FROM d),
t AS (SELECT *, regexp_extract_all(regexp_replace(line, '{FIELD}', '<*>', 'g'), '{TOKEN}') AS tokens FROM l),
f AS (SELECT *, substr(md5(concat(len(tokens), ':', array_to_string(tokens[1:{DEPTH}], ' '))), 1, 15) AS leaf FROM t WHERE len(tokens) > 0),
y AS (SELECT doc_id, list_sort(list(DISTINCT leaf))[1:{PROFILE}] AS profile FROM f GROUP BY doc_id),
s AS (SELECT f.* FROM f SEMI JOIN (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}) USING (leaf)),
e AS (SELECT leaf, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS spot FROM s),
c AS (SELECT leaf, spot, token, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT leaf, spot, sum(n) AS total, max(n) AS most FROM c GROUP BY ALL),
w AS (SELECT c.leaf, c.spot, m.total, m.most, max(token) AS token FROM c JOIN m ON c.leaf = m.leaf AND c.spot = m.spot AND c.n = m.most GROUP BY ALL),
p AS (SELECT leaf, list(CASE WHEN most * 2 >= total THEN token ELSE '<*>' END ORDER BY spot) AS template FROM w GROUP BY leaf),
o AS (SELECT s.doc_id, s.line, array_to_string(CASE WHEN
        len(list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = template[i])) >= len(tokens) * {SIMILARITY} THEN template ELSE tokens END, ' ') AS template
      FROM s JOIN p USING (leaf)),
n AS (SELECT DISTINCT template, doc_id FROM o),
r1 AS (SELECT template, min(doc_id) AS r FROM n GROUP BY template HAVING count(*) >= {MIN_DOCS}),
v1 AS (SELECT n.template, n.doc_id, {_UNION.format(PROFILE=PROFILE)} FROM n JOIN r1 USING (template) JOIN y p ON p.doc_id = n.doc_id JOIN y q ON q.doc_id = r1.r WHERE n.doc_id <> r1.r),
n2 AS (SELECT template, doc_id FROM v1 WHERE {_APART}),
r2 AS (SELECT template, min(doc_id) AS r FROM n2 GROUP BY template),
v2 AS (SELECT n2.template, {_UNION.format(PROFILE=PROFILE)} FROM n2 JOIN r2 USING (template) JOIN y p ON p.doc_id = n2.doc_id JOIN y q ON q.doc_id = r2.r WHERE n2.doc_id <> r2.r),
g AS (SELECT DISTINCT template FROM v2 WHERE {_APART}),
x AS (SELECT doc_id, list(DISTINCT line) AS gone FROM o SEMI JOIN g USING (template) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ls) AS n_lines, CASE WHEN gone IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(gone, x)) END AS kept
      FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n_lines, n_lines - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""

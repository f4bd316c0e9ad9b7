"""Semi, anti, tiered and similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.functions import numbers, urls
from leadloom.functions.text import title_keywords
from leadloom.operators.entities import first_independent, rank_within
from leadloom.operators.projections import target_projects

REACHABLE = ("primary_email", "primary_contact_form_url", "instagram_url", "linkedin_url", "facebook_url")


def project_ids(child: DataFrame, where: Column | None = None) -> DataFrame:
    """Distinct project ids with a qualifying child row."""
    rows = child if where is None else child.filter(where)
    return rows.filter(F.col("project_id").isNotNull()).select(F.col("project_id").alias("id")).distinct()


def reachable_ids(contacts: DataFrame) -> DataFrame:
    return project_ids(contacts, F.coalesce(*[F.col(c) for c in REACHABLE]).isNotNull())


def preparedness(
    projects: DataFrame, researches: DataFrame, contacts: DataFrame, drafts: DataFrame
) -> DataFrame:
    """Projects with ``research_done``, ``contact_done`` and ``email_done``.

    One union and one aggregate build the three flags, so the child tables are
    shuffled once and joined once.
    """
    kinds = [
        (researches.filter(F.col("research_status") == "completed"), "research_done"),
        (contacts, "contact_done"),
        (drafts, "email_done"),
    ]
    parts = [
        df.filter(F.col("project_id").isNotNull()).select(
            F.col("project_id").alias("id"),
            *[F.lit(name == flag).alias(flag) for _, flag in kinds],
        )
        for df, name in kinds
    ]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    flags = long.groupBy("id").agg(*[F.bool_or(flag).alias(flag) for _, flag in kinds])
    return projects.join(flags, "id", "left").fillna(
        False, ["research_done", "contact_done", "email_done"]
    )


def prepared(projects, researches, contacts, drafts) -> DataFrame:
    flagged = preparedness(projects, researches, contacts, drafts)
    return flagged.filter("research_done AND contact_done AND email_done")


def reachable(projects: DataFrame, contacts: DataFrame) -> DataFrame:
    return projects.join(reachable_ids(contacts), "id", "left_semi")


def not_assessed(projects: DataFrame, assessments: DataFrame, site: str | None = None) -> DataFrame:
    rows = target_projects(projects)
    if site:
        rows = rows.filter(F.col("source_site") == site)
    return rows.join(project_ids(assessments), "id", "left_anti")


def category_key(category: Column, fold_case: bool) -> Column:
    key = F.nullif(F.trim(category), F.lit(""))
    return F.lower(key) if fold_case else key


def same_category_exists(projects: DataFrame, cases: DataFrame, fold_case: bool = False) -> DataFrame:
    """Adds ``similar_category``. The distinct categories are an aggregate of the
    case table; Spark broadcasts them when they are small enough."""
    kept = cases.select(
        (category_key(F.col("category"), True) if fold_case else F.col("category")).alias("category_key")
    ).filter(F.col("category_key").isNotNull()).distinct()
    return (
        projects.withColumn("category_key", category_key(F.col("category"), fold_case))
        .join(kept.withColumn("similar_category", F.lit(True)), "category_key", "left")
        .fillna(False, ["similar_category"])
        .drop("category_key")
    )


# --- similar success cases --------------------------------------------------------

def funding_bonus(raised: Column, goal: Column) -> Column:
    rate = F.when((raised != 0) & (goal != 0), numbers.funding_percent_rounded(raised, goal))
    return numbers.ladder(F.coalesce(rate, F.lit(0)), [(1000, 25), (300, 15), (100, 8)], 0)


def _keyword_sets(keywords: Column) -> Column:
    """All sets of one, two and three keywords, each as a joined string."""
    one = F.transform(keywords, lambda a: F.struct(F.lit(1).alias("n"), a.alias("words")))
    tail = lambda i: F.slice(keywords, i + 2, F.size(keywords))
    two = F.flatten(
        F.transform(
            keywords,
            lambda a, i: F.transform(
                tail(i), lambda b: F.struct(F.lit(2).alias("n"), F.concat_ws(" ", a, b).alias("words"))
            ),
        )
    )
    three = F.flatten(
        F.flatten(
            F.transform(
                keywords,
                lambda a, i: F.transform(
                    tail(i),
                    lambda b, j: F.transform(
                        F.slice(keywords, i + j + 3, F.size(keywords)),
                        lambda c: F.struct(F.lit(3).alias("n"), F.concat_ws(" ", a, b, c).alias("words")),
                    ),
                ),
            )
        )
    )
    return F.concat(one, two, three)


def _blocks(rows: DataFrame, category: str) -> DataFrame:
    """Explode a row into the blocks it belongs to.

    A block is (category or any, set of at most three shared keywords). The set
    may be empty only together with a category.
    """
    sets = F.col("keyword_sets")
    any_category = F.transform(
        sets, lambda s: F.struct(F.lit("").alias("cat"), F.lit(0).alias("same"), s["n"].alias("n"), s["words"].alias("words"))
    )
    own = F.transform(
        F.concat(F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("words"))), sets),
        lambda s: F.struct(F.col(category).alias("cat"), F.lit(1).alias("same"), s["n"].alias("n"), s["words"].alias("words")),
    )
    has_category = F.col(category).isNotNull() & (F.col(category) != "")
    every = F.when(has_category, F.concat(any_category, own)).otherwise(any_category)
    return rows.withColumn("block", F.explode(every)).select("*", "block.*").drop("block", "keyword_sets")


def similar_cases(projects: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """Top-k success cases for every project, exact and without a pair explosion.

    A pair scores 70 for the same category, 5 per shared title keyword up to 15,
    plus a bonus that depends on the case alone, capped at 100. So inside a block
    of cases that share a given category and a given set of up to three keywords,
    a case outside the block's best k (by score floor, then id) can never reach
    any project's best k: k others score at least as much and come first. Keeping
    k cases per block therefore loses nothing, and each project looks up a number
    of blocks that depends on its own title only.
    """
    scored = cases.select(
        F.col("id").alias("case_id"),
        F.col("category").alias("case_category"),
        F.array_sort(title_keywords(F.coalesce(F.col("title"), F.lit("")))).alias("case_keywords"),
        funding_bonus(F.col("raised_amount"), F.col("goal_amount")).alias("bonus"),
        F.coalesce(F.col("raised_amount").cast("double"), F.lit(0.0)).alias("case_raised"),
    )
    blocks = _blocks(scored.withColumn("keyword_sets", _keyword_sets(F.col("case_keywords"))), "case_category")
    floor = F.least(F.lit(100), F.col("same") * 70 + F.col("n") * 5 + F.col("bonus"))
    w = Window.partitionBy("cat", "same", "words").orderBy(floor.desc(), F.col("case_id"))
    best = blocks.withColumn("floor", floor).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    best = best.groupBy("cat", "same", "words").agg(F.collect_list(F.struct("case_id", "floor")).alias("best"))

    wanted = projects.select(
        F.col("id").alias("project_id"),
        F.col("category").alias("project_category"),
        F.array_sort(title_keywords(F.coalesce(F.col("title"), F.lit("")))).alias("keywords"),
    )
    lookups = _blocks(wanted.withColumn("keyword_sets", _keyword_sets(F.col("keywords"))), "project_category").select("project_id", "cat", "same", "words")
    # a pair's score is the floor of the narrowest block it meets in, which is its largest one
    pairs = lookups.join(best, ["cat", "same", "words"]).select("project_id", F.explode("best").alias("x"))
    pairs = pairs.groupBy("project_id", "x.case_id").agg(F.max("x.floor").alias("score"))
    w = Window.partitionBy("project_id").orderBy(F.col("score").desc(), F.col("case_id"))
    top = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    # titles meet only for the pairs that are left; ids may repeat or be missing
    one = lambda rows, key: rows.groupBy(F.col(key).alias(f"{key}_")).agg(F.max(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(f"{key}_", "r.*")
    for side, key in ((wanted, "project_id"), (scored.select("case_id", "case_category", "case_keywords"), "case_id")):
        top = top.join(one(side, key), F.col(key).eqNullSafe(F.col(f"{key}_")), "left").drop(f"{key}_")
    shared = F.array_intersect(F.col("keywords"), F.col("case_keywords"))
    same = F.coalesce(F.col("project_category") == F.col("case_category"), F.lit(False)) & (F.col("project_category") != "")
    ranked = top.select("project_id", "case_id", "score", F.array_join(shared, ",").alias("shared_keywords"), F.coalesce(same, F.lit(False)).alias("same_category"), "rank")

    # fallback: the k best-funded cases, k rows whatever the data size
    funded = scored.orderBy(F.col("case_raised").desc(), F.col("case_id")).limit(k)
    fallback_score = F.greatest(F.lit(1), F.col("bonus"))
    funded = funded.select(
        "case_id",
        fallback_score.alias("score"),
        F.row_number().over(Window.orderBy(fallback_score.desc(), F.col("case_raised").desc(), F.col("case_id"))).alias("rank"),
    )
    unmatched = wanted.select("project_id").join(ranked.select("project_id"), "project_id", "left_anti")
    listed = funded.agg(F.array_sort(F.collect_list(F.struct("rank", "case_id", "score"))).alias("cases"))
    fallback = (
        unmatched.join(F.broadcast(listed), F.lit(True), "left")  # one row of k entries
        .select("project_id", F.explode("cases").alias("c"))
        .select(
            "project_id",
            "c.case_id",
            "c.score",
            F.lit("").alias("shared_keywords"),
            F.lit(False).alias("same_category"),
            "c.rank",
        )
    )
    return ranked.unionByName(fallback)


# --- makers ------------------------------------------------------------------------

def match_makers(projects: DataFrame, makers: DataFrame) -> DataFrame:
    """Maker of every project: existing link, else same website, else same name,
    else a new maker shared by the projects that would have found it.

    Returns ``id, maker_id, how`` with ``how`` in link, website, name, new; a new
    maker's id follows the largest existing one.
    """
    site = F.when(urls.is_business_url(F.col("maker_url")), F.trim(F.col("maker_url")))
    label = F.coalesce(F.nullif(F.col("maker_name"), F.lit("")), F.col("title"))
    rows = projects.select(
        "id",
        "maker_id",
        site.alias("site"),
        F.nullif(F.lower(F.trim(label)), F.lit("")).alias("label"),
    )
    by_id = makers.select(F.col("id").alias("maker_id"), F.col("id").alias("linked"))
    by_site = makers.filter(F.col("website_url").isNotNull()).groupBy(F.col("website_url").alias("site")).agg(F.min("id").alias("site_maker"))
    by_name = makers.groupBy(F.lower("name").alias("label")).agg(F.min("id").alias("name_maker"))
    found = (
        rows.join(by_id, "maker_id", "left").join(by_site, "site", "left").join(by_name, "label", "left")
    )
    known = found.filter(F.coalesce("linked", "site_maker", "name_maker").isNotNull()).select(
        "id",
        F.coalesce("linked", "site_maker", "name_maker").alias("maker_id"),
        F.when(F.col("linked").isNotNull(), "link")
        .when(F.col("site_maker").isNotNull(), "website")
        .otherwise("name")
        .alias("how"),
    )
    new = found.filter(F.coalesce("linked", "site_maker", "name_maker").isNull()).select("id", "site", "label")
    keys = new.select(
        "id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("site").isNotNull(), F.concat(F.lit("u:"), "site")),
                    F.when(F.col("label").isNotNull(), F.concat(F.lit("n:"), "label")),
                )
            )
        ).alias("key"),
    )
    founders = first_independent(keys)
    numbered = rank_within(founders.join(new, "id"), [], ["id"], "n")
    top = makers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = numbered.join(F.broadcast(top), F.lit(True)).withColumn("new_maker", F.col("top") + F.col("n"))
    new_site = numbered.filter(F.col("site").isNotNull()).groupBy("site").agg(F.min("new_maker").alias("s"))
    new_name = numbered.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("new_maker").alias("m"))
    created = (
        new.join(new_site, "site", "left")
        .join(new_name, "label", "left")
        .select("id", F.coalesce("s", "m").alias("maker_id"), F.lit("new").alias("how"))
    )
    return known.unionByName(created)


# --- captures ------------------------------------------------------------------------

def canonical_url(url: Column) -> Column:
    """No query, fragment or trailing slash, lower case."""
    return F.rtrim(F.lower(F.regexp_extract(F.trim(url), r"^([^?#]*)", 1)), F.lit("/"))


def campaign_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/campaign/(?:detail|example)/([A-Za-z0-9_\-]+)", 1), F.lit(""))


def resolve_captures(captures: DataFrame, projects: DataFrame, site: str = "wadiz") -> DataFrame:
    """All projects of the best tier: exact URL, campaign id, canonical URL. The last
    two only look at projects of the captured site."""
    left = captures.select(
        "capture_id", "url", campaign_id(F.col("url")).alias("cid"), canonical_url(F.col("url")).alias("canon")
    )
    own = F.col("source_site") == site
    right = projects.filter(F.col("source_url").isNotNull()).select(
        F.col("id").alias("project_id"),
        F.col("source_url"),
        F.when(own, campaign_id(F.col("source_url"))).alias("p_cid"),
        F.when(own, canonical_url(F.col("source_url"))).alias("p_canon"),
    )
    tiers = [("url", "source_url"), ("cid", "p_cid"), ("canon", "p_canon")]
    hits = None
    for tier, (a, b) in enumerate(tiers, start=1):
        hit = left.join(right, left[a] == right[b]).select("capture_id", "project_id", F.lit(tier).alias("tier"))
        hits = hit if hits is None else hits.unionByName(hit)
    best = hits.groupBy("capture_id").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["capture_id", "tier"]).select("capture_id", "project_id", "tier")


def unvisited(frontier: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Frontier minus visited pages, equal up to one trailing slash run."""
    bare = F.rtrim(F.col(url), F.lit("/"))
    seen = visited.select(bare.alias("bare")).distinct()
    return frontier.withColumn("bare", bare).join(seen, "bare", "left_anti").drop("bare")


def parse_robots(robots: DataFrame) -> DataFrame:
    """``(host, robots_txt)`` to one row per disallowed prefix of the ``*`` agent."""
    lines = robots.select("host", F.posexplode(F.split("robots_txt", r"\r?\n")).alias("pos", "line"))
    clean = F.trim(F.col("line"))
    tagged = lines.select(
        "host",
        "pos",
        F.lower(F.trim(F.regexp_extract(clean, r"(?i)^user-agent:(.*)$", 1))).alias("agent"),
        clean.rlike(r"(?i)^user-agent:").alias("is_agent"),
        F.trim(F.regexp_extract(clean, r"(?i)^disallow:(.*)$", 1)).alias("prefix"),
    )
    w = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(F.when(F.col("is_agent"), F.col("agent")), ignorenulls=True).over(w)
    return (
        tagged.withColumn("current", current)
        .filter((F.col("current") == "*") & (F.col("prefix") != ""))
        .select("host", "prefix")
        .distinct()
    )


def allowed_by_robots(frontier: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Drop URLs whose path starts with a disallowed prefix of their host."""
    keyed = frontier.withColumn("host", urls.hostname(F.col(url)))
    p = urls.path(F.col(url))
    path = F.when(p == "", F.lit("/")).otherwise(p)
    rules = rules.select(F.col("host").alias("rule_host"), "prefix")
    hit = (F.col("host") == F.col("rule_host")) & F.startswith(F.col("path"), F.col("prefix"))
    return keyed.withColumn("path", path).join(rules, hit, "left_anti").drop("host", "path")

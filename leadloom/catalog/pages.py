"""Page, URL, address and site operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.catalog import query
from leadloom.catalog.boards import official, under
from leadloom.catalog.inputs import joined
from leadloom.catalog.lists import q
from leadloom.domain import table, with_tables
from leadloom.functions import text as tx
from leadloom.functions import urls
from leadloom.functions.pandas_udfs import nfkc
from leadloom.operators import contacts as ct
from leadloom.operators import emails as em
from leadloom.operators import sites

# --- URL functions, restated in SQL ------------------------------------------------------


def net(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def upath(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def www(h: str) -> str:
    return f"regexp_replace({h}, '^www[.]', '')"


def labels(h: str) -> str:
    return f"string_split({h}, '.')"


def reg(h: str) -> str:
    two = f"array_to_string({labels(h)}[-2:], '.')"
    return f"CASE WHEN {two} IN ({q(vocab.TWO_LEVEL_SUFFIXES)}) THEN array_to_string({labels(h)}[-3:], '.') ELSE {two} END"


def has(text: str, terms) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, t.replace("'", "''")) for t in terms) + ")"


def starts(text: str, terms) -> str:
    return "(" + " OR ".join(f"starts_with({text}, '{t}')" for t in terms) + ")"


RESULTS = f"r AS (SELECT *, {net('url')} AS net, {www(net('url'))} AS host, {upath('url')} AS path, lower({upath('url')}) AS lpath FROM results), h AS (SELECT *, {reg('host')} AS reg FROM r)"
REASON = (
    "CASE WHEN split_part(url, ':', 1) NOT IN ('http', 'https') THEN 'scheme:' || split_part(url, ':', 1) WHEN net IN ('127.0.0.1', '0.0.0.0', 'localhost') THEN 'dummy_host:' || net "
    f"WHEN list_has_any({labels('net')}, [{q(vocab.PLACEHOLDER_HOST_LABELS)}]) THEN 'dummy_host:' || list_filter({labels('net')}, lambda x: x IN ({q(vocab.PLACEHOLDER_HOST_LABELS)}))[1] "
    + " ".join(f"WHEN contains(lpath, '{p}') THEN 'placeholder_path:{p}'" for p in vocab.PLACEHOLDER_PATHS)
    + " END"
)


def results(spark, sf):
    return table(spark, sf, "results")


@query("url01_domains", with_tables("results", then=f"WITH {RESULTS} SELECT id, host, reg AS registrable, {labels('reg')}[1] AS token FROM h"))
def url01(spark, sf):
    u = F.col("url")
    return results(spark, sf).select("id", urls.host_of(u).alias("host"), urls.registrable_domain(u).alias("registrable"), urls.domain_token(u).alias("token"))


@query("url02_business_url", with_tables("results", then=f"WITH {RESULTS} SELECT id, {REASON} AS reason FROM h"))
def url02(spark, sf):
    return results(spark, sf).select("id", urls.business_url_reason(F.col("url")).alias("reason"))


_PN = "regexp_extract(lower(source_url), '^https?://([^/?#]*)', 1)"


@query(
    "url03_campaign_state",
    with_tables("projects", then=f"""
    SELECT id, CASE WHEN source_site NOT IN ({q(vocab.CAMPAIGN_DOMAINS)}) THEN 'unsupported_site' WHEN source_url IS NULL THEN 'no_source_url' WHEN {_PN} = 'example.com' THEN 'invalid_url'
      WHEN NOT ({' OR '.join(f"(source_site = '{s}' AND ({_PN} = '{d}' OR {_PN} LIKE '%.{d}'))" for s, d in vocab.CAMPAIGN_DOMAINS.items())}) THEN 'not_campaign_domain' END AS reason FROM projects"""),
)
def url03(spark, sf):
    return table(spark, sf, "projects").select("id", urls.campaign_url_reason(F.col("source_url"), F.col("source_site")).alias("reason"))


def rule(domains=(), brands=(), prefixes=()) -> str:
    tests = [under("host", domains)]
    if brands:
        tests.append(f"{labels('reg')}[1] IN ({q(brands)})")
    tests += [f"(host = '{p}' OR starts_with(host, '{p}.'))" for p in prefixes]
    return "(" + " OR ".join(tests) + ")"


GROUP = (
    f"CASE WHEN {rule(vocab.MARKETPLACE_DOMAINS, vocab.MARKETPLACE_BRANDS, vocab.MARKETPLACE_PREFIXES)} THEN 'marketplace' WHEN {rule(vocab.BLOG_PLATFORMS)} THEN 'blog' "
    f"WHEN {rule(vocab.DIRECTORY_DOMAINS, vocab.DIRECTORY_BRANDS)} THEN 'directory' WHEN {rule(vocab.NEWS_DOMAINS, vocab.NEWS_BRANDS, vocab.NEWS_PREFIXES)} THEN 'news' END"
)


@query("url04_host_group", with_tables("results", then=f"WITH {RESULTS} SELECT id, {GROUP} AS host_group FROM h"))
def url04(spark, sf):
    return results(spark, sf).select("id", sites.host_group(F.col("url")).alias("host_group"))


_SEG = "list_filter(string_split(path, '/'), lambda s: s <> '')"


@query(
    "url05_social_profiles",
    with_tables("results", then=f"""WITH {RESULTS}, s AS (SELECT *, {_SEG} AS seg FROM h)
    SELECT id, CASE WHEN contains(net, 'instagram.com') AND len(seg) >= 1 AND lower(seg[1]) NOT IN ({q(vocab.INSTAGRAM_NON_PROFILE)}) AND regexp_full_match(seg[1], '[A-Za-z0-9_.]+') THEN 'https://www.instagram.com/' || seg[1] || '/' END AS instagram,
      CASE WHEN contains(net, 'facebook.com') AND len(seg) >= 1 AND lower(seg[1]) NOT IN ({q(vocab.FACEBOOK_NON_PROFILE)}) THEN CASE WHEN lower(seg[1]) = 'pages' AND len(seg) >= 2 THEN 'https://www.facebook.com/' || array_to_string(seg[1:3], '/') ELSE 'https://www.facebook.com/' || seg[1] END END AS facebook,
      CASE WHEN contains(net, 'linkedin.com') AND len(seg) >= 2 THEN CASE WHEN lower(seg[1]) IN ('company', 'school', 'showcase') THEN 'https://www.linkedin.com/company/' || seg[2] || '/' WHEN lower(seg[1]) = 'in' THEN 'https://www.linkedin.com/in/' || seg[2] || '/' END END AS linkedin FROM s"""),
)
def url05(spark, sf):
    u = F.col("url")
    return results(spark, sf).select("id", *[sites.social_profile(F.lit(p), u).alias(p) for p in ("instagram", "facebook", "linkedin")])


@query(
    "url07_page_kind",
    with_tables("results", then=f"""WITH {RESULTS}, k AS (SELECT *, rtrim(lpath, '/') AS p FROM h)
    SELECT id, CASE WHEN p = '' THEN 'root' WHEN {has('p', ('contact', 'support', 'help', 'impressum', 'kontakt', 'customer-service', 'inquiry'))} THEN 'contact'
      WHEN {has('p', ('about', 'company', 'team', 'our-story', 'who-we-are'))} THEN 'about' WHEN {has('p', ('privacy', 'terms', 'legal', 'imprint', 'policy'))} THEN 'legal' ELSE 'other' END AS kind,
      CASE WHEN contains(lower(url), 'linkedin.com') THEN CASE WHEN contains(lower(url), '/company/') THEN 'company' WHEN contains(lower(url), '/in/') THEN 'person' END END AS linkedin FROM k"""),
)
def url07(spark, sf):
    u = F.col("url")
    return results(spark, sf).select("id", sites.path_kind(u).alias("kind"), sites.linkedin_kind(u).alias("linkedin"))


@query(
    "sort09_crawl_frontier",
    with_tables("results", then=f"""WITH {RESULTS}, l AS (SELECT *, lower(url) AS u FROM h),
    t AS (SELECT id, url, host AS domain, CASE WHEN {has('u', vocab.CRAWL_TIERS[0])} THEN 0 WHEN {has('u', vocab.CRAWL_TIERS[1])} THEN 1 WHEN {has('u', vocab.CRAWL_TIERS[2])} THEN 2 ELSE 3 END AS tier,
      {' + '.join(f"CASE WHEN contains(u, '{w}') THEN 1 ELSE 0 END" for w in vocab.CRAWL_LINK_WORDS)} AS words FROM l
      WHERE NOT {has('u', vocab.CRAWL_SKIP_WORDS)} AND NOT regexp_matches(u, '{vocab.PAGINATION_PATTERN}') AND NOT {has('u', vocab.PAGINATION_PATHS)})
    SELECT domain, url, tier, CAST(row_number() OVER (PARTITION BY domain ORDER BY tier, words DESC, url) AS INT) AS position FROM (SELECT DISTINCT domain, url, tier, words FROM t)"""),
)
def sort09(spark, sf):
    frontier = results(spark, sf).select("url").distinct()
    return sites.crawl_frontier(frontier).select("domain", "url", "tier", "position")


@query(
    "sort10_sitemap_urls",
    with_tables("results", then=f"""WITH {RESULTS}, s AS (SELECT host AS domain, url, min(id) AS pos FROM h WHERE net <> '' AND url LIKE 'http%' GROUP BY ALL)
    SELECT domain, url, CAST(row_number() OVER (PARTITION BY domain ORDER BY {has('lower(url)', vocab.SITEMAP_WORDS)} DESC, pos, url) AS INT) AS position FROM s"""),
)
def sort10(spark, sf):
    rows = results(spark, sf).filter(F.col("url").rlike("^http")).withColumn("domain", urls.domain_of(F.col("url")))
    listed = rows.groupBy("domain", "url").agg(F.min("id").alias("id"))
    entry = F.concat(F.lit("<url><loc> "), F.col("e.url"), F.lit(" </loc></url>"))
    xml = listed.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("id", "url"))).alias("entries"))
    xml = xml.select("domain", F.explode("entries").alias("e")).select("domain", "e.id", entry.alias("line"))
    xml = xml.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("xml"))
    return sites.sitemap_urls(xml).select("domain", "url", "position")


# --- search results -----------------------------------------------------------------------------

DENY = "CASE " + " ".join(
    f"WHEN reg IN ({q(d)})" + (f" OR host IN ({q(d)})" if n == "messenger" else "") + f" THEN '{n}'" for n, d in em.DENY_LISTS
) + " END"


@query("ext17_official_eligible", with_tables("results", then=f"SELECT id, {official('url')} AS eligible FROM results"))
def ext17(spark, sf):
    return results(spark, sf).select("id", urls.official_site_or_none(F.col("url")).isNotNull().alias("eligible"))


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{3,}}'))"


@query(
    "ext18_confirmation",
    with_tables("results", then=f"""WITH {RESULTS}, e AS (SELECT *, {labels('host')}[1] AS tok, {tokens("concat_ws(' ', maker_name, title)")} AS terms, {tokens('maker_name')} AS mk, {official('url')} AS ok FROM h),
    p AS (SELECT id, ok, list_filter([CASE WHEN tok <> '' AND len(list_filter(terms, lambda t: contains(t, tok) OR contains(tok, t))) > 0 THEN 'domain' END, CASE WHEN list_has_any({tokens('title')}, mk) THEN 'site_name' END,
      CASE WHEN list_has_any({tokens('snippet')}, mk) THEN 'jsonld_org' END, CASE WHEN position < 5 THEN 'direct_link' END], lambda x: x IS NOT NULL) AS ev FROM e)
    SELECT id, CASE WHEN NOT ok THEN 'rejected' WHEN len(ev) >= 2 THEN 'accepted' ELSE 'uncertain' END AS decision,
      CASE WHEN ok THEN CAST(CASE WHEN list_contains(ev, 'domain') THEN 40 ELSE 0 END + CASE WHEN list_contains(ev, 'site_name') THEN 35 ELSE 0 END + CASE WHEN list_contains(ev, 'jsonld_org') THEN 35 ELSE 0 END + CASE WHEN list_contains(ev, 'direct_link') THEN 30 ELSE 0 END AS INT) ELSE 0 END AS score,
      CASE WHEN ok THEN array_to_string(ev, ',') ELSE '' END AS evidence FROM p"""),
)
def ext18(spark, sf):
    rows = results(spark, sf)
    got = sites.confirm_official(F.col("url"), maker_name=F.col("maker_name"), product_title=F.col("title"), direct_linked=F.col("position") < 5, jsonld_org=F.col("snippet"), site_name=F.col("title"))
    return rows.select("id", *[c.alias(n) for n, c in got.items()]).withColumn("evidence", F.array_join("evidence", ","))


@query(
    "ext22_pick_official",
    with_tables("results", then=f"""WITH {RESULTS}, c AS (SELECT project_id, url, host, length(path) AS depth, CASE position % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'candidate' END AS verdict, CASE position % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf,
      CASE WHEN position % 5 = 0 THEN 2 ELSE 1 END AS src FROM h),
    v AS (SELECT project_id, arg_max(url, (CASE conf WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, src, -depth, url)) AS url, arg_max(conf, (CASE conf WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, src, -depth, url)) AS conf, count(DISTINCT host) AS n FROM c WHERE verdict = 'official' GROUP BY 1),
    d AS (SELECT project_id, arg_min(url, (depth, url)) AS url, count(DISTINCT host) AS n FROM c WHERE conf = 'high' AND host <> '' GROUP BY 1)
    SELECT p.project_id, CASE WHEN v.n > 0 THEN CASE WHEN v.n = 1 OR v.conf = 'high' THEN v.url END WHEN d.n = 1 THEN d.url END AS official_site_url,
      CASE WHEN v.n > 0 THEN CASE WHEN v.n = 1 OR v.conf = 'high' THEN 'verified' ELSE 'several_verified_domains' END WHEN d.n = 1 THEN 'single_direct_link' WHEN d.n > 1 THEN 'several_direct_domains' ELSE 'only_weak_candidates' END AS reason
    FROM (SELECT DISTINCT project_id FROM c) p LEFT JOIN v ON v.project_id = p.project_id LEFT JOIN d ON d.project_id = p.project_id"""),
)
def ext22(spark, sf):
    n = F.col("position")
    rows = results(spark, sf).select(
        "project_id", "url", F.when(n % 4 == 0, "official").when(n % 4 == 1, "candidate").alias("verdict"),
        F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low").alias("confidence"), F.when(n % 5 == 0, "page_direct_link").otherwise("search_result").alias("source"),
    )
    return sites.pick_official_site(rows)


STOP = q(vocab.SEARCH_STOP_WORDS)
SCORED = f"""{RESULTS}, pt AS (SELECT *, list_filter({tokens("'aurora lamp'")}, lambda t: t NOT IN ({STOP})) AS pterms, list_filter({tokens('maker_name')}, lambda t: t NOT IN ({STOP})) AS mterms,
  net || ' ' || translate(lpath, '/-_', '   ') AS addr, lower(concat_ws(' ', coalesce(title, ''), coalesce(snippet, ''))) AS words, {_SEG} AS seg FROM h),
f AS (SELECT *, len(list_filter(pterms, lambda t: contains(addr, t))) > 0 AS a, len(list_filter(mterms, lambda t: contains(addr, t))) > 0 AS b, len(list_filter(pterms, lambda t: contains(words, t))) > 0 AS c, len(list_filter(mterms, lambda t: contains(words, t))) > 0 AS d,
  coalesce(ends_with(net, official_domain), false) AS o, contains(net, 'instagram.com') AND len(seg) >= 1 AND lower(seg[1]) NOT IN ({q(vocab.INSTAGRAM_NON_PROFILE)}) AND regexp_full_match(seg[1], '[A-Za-z0-9_.]+') AS ig,
  contains(net, 'facebook.com') AND len(seg) >= 1 AND lower(seg[1]) NOT IN ({q(vocab.FACEBOOK_NON_PROFILE)}) AS fb, contains(net, 'linkedin.com') AND len(seg) >= 2 AND lower(seg[1]) IN ('company', 'in') AS li,
  {has('lower(url)', vocab.SEARCH_EXCLUDED_PARTS)} AS bad, {under('host', vocab.NON_OFFICIAL_PLATFORMS)} AS plat FROM pt),
scored AS (SELECT *, CASE WHEN bad OR plat THEN -1 ELSE CASE WHEN a THEN 30 ELSE 0 END + CASE WHEN b THEN 25 ELSE 0 END + CASE WHEN c AND d THEN 25 WHEN c OR d THEN 10 ELSE 0 END + CASE WHEN o THEN 30 ELSE 0 END
  + CASE WHEN ig THEN 35 WHEN fb THEN 30 WHEN li THEN 35 ELSE 0 END END AS score FROM f)"""


def scored_results(spark, sf):
    rows = results(spark, sf).withColumns({"project_terms": sites.search_terms(F.lit("aurora lamp")), "maker_terms": sites.search_terms(F.col("maker_name"))})
    score, reason = sites.search_result_score(F.col("url"), F.col("title"), F.col("snippet"), project_terms=F.col("project_terms"), maker_terms=F.col("maker_terms"), official_domain=F.col("official_domain"))
    return rows.withColumns({"score": score, "reason": reason})


@query("ext23_search_scores", with_tables("results", then=f"WITH {SCORED} SELECT id, CAST(score AS INT) AS score FROM scored"))
def ext23(spark, sf):
    return scored_results(spark, sf).select("id", F.col("score").cast("int").alias("score"))


@query(
    "ext24_inferred_official",
    with_tables("results", then=f"""WITH {SCORED}, k AS (SELECT *, {labels('host')}[1] AS tok, list_concat(pterms, mterms) AS terms FROM scored WHERE score >= 0)
    SELECT project_id, arg_max(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), (score, -position, -id)) AS official_url FROM k
    WHERE tok <> '' AND NOT {has('net', vocab.SEARCH_NON_OFFICIAL_HINTS)} AND len(list_filter(terms, lambda t: contains(tok, t) OR contains(t, tok))) > 0 GROUP BY 1"""),
)
def ext24(spark, sf):
    rows = scored_results(spark, sf).filter("score >= 0")
    rows = rows.withColumn("terms", F.concat("project_terms", "maker_terms"))
    # several results share a rank here; the event id makes the order total
    rows = rows.withColumn("position", F.col("position").cast("long") * 1_000_000_000 + F.col("id"))
    return sites.infer_official(rows)


def _shows(text: str, group) -> str:
    tests = [f"list_contains(regexp_extract_all({text}, '[a-z0-9]+'), '{a}')" if a.isascii() else f"contains(regexp_replace({text}, '\\s+', '', 'g'), '{a}')" for a in group]
    return "(" + " OR ".join(tests) + ")"


FRONT = ("'Brandworks | lamps'", "'LG전자 Brandworks'", "'Access denied: Brandworks'", "'Brand  works'", "'Shop of all things'")
FRONT_SQL = "CASE length(host) % 5 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(FRONT)) + " END"
TITLED = f"""{SCORED}, m AS (SELECT *, coalesce(maker_name, '') AS maker, {FRONT_SQL} AS front, regexp_replace(regexp_replace(coalesce(maker_name, ''), '{"|".join(re.escape(f) for f in vocab.CORPORATE_FORMS)}', ' ', 'g'), '\\s+', '', 'g') AS core,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root FROM scored),
titled AS (SELECT project_id, arg_max(root, (score, -position, -id)) AS official_url FROM m WHERE length(core) >= 2 AND host <> '' AND contains(regexp_replace(coalesce(title, ''), '\\s+', '', 'g'), core)
  AND NOT {has('net', vocab.SEARCH_NON_OFFICIAL_HINTS + vocab.TITLE_CANDIDATE_DENY)} AND NOT {has('lower(front)', vocab.IDENTITY_ERROR_WORDS)} AND contains(regexp_replace(front, '\\s+', '', 'g'), core)
  AND NOT ({" OR ".join(f"({_shows('lower(front)', g)} AND NOT {_shows('lower(maker)', g)})" for g in vocab.MAJOR_BRANDS)}) GROUP BY 1)"""


def front_pages(spark, sf):
    """Names on the front page of every domain among the results."""
    host = urls.domain_of(F.col("url"))
    n = F.length("domain") % len(FRONT)
    title = F.coalesce(*[F.when(n == i, F.lit(t.strip("'"))) for i, t in enumerate(FRONT)])
    pages = results(spark, sf).select(host.alias("domain")).distinct().select("domain", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.concat(F.lit("<title>"), title, F.lit("</title>")).alias("html"))
    return sites.site_identity(pages).select("domain", "names")


def titled_results(spark, sf):
    rows = scored_results(spark, sf).withColumn("terms", F.concat("project_terms", "maker_terms"))
    return rows.withColumn("position", F.col("position").cast("long") * 1_000_000_000 + F.col("id"))


@query("ext24_official_by_title", with_tables("results", then=f"WITH {TITLED} SELECT project_id, official_url FROM titled"))
def ext24b(spark, sf):
    return sites.official_by_title(titled_results(spark, sf), front_pages(spark, sf))


@query(
    "ext24_official_site",
    with_tables("results", then=f"""WITH {TITLED}, k AS (SELECT *, {labels('host')}[1] AS tok, list_concat(pterms, mterms) AS terms FROM scored),
    d AS (SELECT project_id, arg_max(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), (score, -position, -id)) AS official_url FROM k
    WHERE tok <> '' AND NOT {has('net', vocab.SEARCH_NON_OFFICIAL_HINTS)} AND len(list_filter(terms, lambda t: contains(tok, t) OR contains(t, tok))) > 0 GROUP BY 1)
    SELECT project_id, official_url, 'domain' AS how FROM d UNION ALL SELECT project_id, official_url, 'title' FROM titled WHERE project_id NOT IN (SELECT project_id FROM d)"""),
)
def ext24c(spark, sf):
    return sites.official_site(titled_results(spark, sf), front_pages(spark, sf))


@query(
    "ext32_candidate_score",
    with_tables("results", then=f"""WITH {RESULTS}, t AS (SELECT *, {labels('host')}[1] AS tok, {tokens("concat_ws(' ', maker_name, 'aurora')")} AS terms FROM h)
    SELECT id, CAST(CASE WHEN tok = '' THEN 0 ELSE coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN t = tok THEN 50 WHEN contains(tok, t) OR contains(t, tok) THEN 25 ELSE 0 END)), 0) + CASE WHEN trim(path, '/') = '' THEN 10 ELSE 0 END END AS INT) AS score FROM t
    WHERE url LIKE 'http%' AND NOT {under('host', vocab.NON_OFFICIAL_PLATFORMS)} AND NOT {has('net', vocab.AGGREGATOR_HOST_HINTS)}"""),
)
def ext32(spark, sf):
    rows = results(spark, sf).filter(sites.is_official_candidate(F.col("url")))
    terms = tx.significant_terms(F.concat_ws(" ", "maker_name", F.lit("aurora")))
    return rows.select("id", sites.official_candidate_score(F.col("url"), terms).cast("int").alias("score"))


# --- addresses ----------------------------------------------------------------------------------

A_SQL = f"""a0 AS (SELECT *, lower(email) AS addr, split_part(lower(email), '@', 1) AS loc, split_part(lower(email), '@', 2) AS dom FROM addresses),
a1 AS (SELECT *, {www('dom')} AS host, {reg(www('dom'))} AS reg FROM a0),
a2 AS (SELECT *, {DENY} AS deny FROM a1),
a3 AS (SELECT *, CASE WHEN dom LIKE '%.png' THEN 'asset_file' WHEN starts_with(dom, 'www.') THEN 'format:www_domain'
    WHEN list_has_any({labels('dom')}, [{q(vocab.PLACEHOLDER_EMAIL_LABELS)}]) THEN 'dummy_domain:' || list_filter({labels('dom')}, lambda x: x IN ({q(vocab.PLACEHOLDER_EMAIL_LABELS)}))[1]
    WHEN len(list_filter(regexp_split_to_array(loc, '[._+0-9-]+'), lambda x: x IN ({q(vocab.PLACEHOLDER_LOCAL_TOKENS)}))) > 0 THEN 'dummy_local:' || list_filter(regexp_split_to_array(loc, '[._+0-9-]+'), lambda x: x IN ({q(vocab.PLACEHOLDER_LOCAL_TOKENS)}))[1]
    WHEN {starts('loc', vocab.NO_REPLY_PREFIXES)} THEN 'noreply' END AS valid_reason,
  regexp_full_match(loc, '[0-9a-f]{{24,}}') OR (length(loc) >= 25 AND regexp_full_match(loc, '[a-z0-9]+') AND length(regexp_replace(loc, '[^0-9]', '', 'g')) >= 4) AS generated FROM a2),
a4 AS (SELECT *, CASE WHEN dom LIKE '%.png' THEN 'asset_file' WHEN dom = 'kickstarter.com' THEN 'platform_domain:kickstarter.com' WHEN dom = site_domain THEN 'platform_domain:' || site_domain
    WHEN deny IS NOT NULL THEN 'third_party_owner:' || deny || ':' || dom WHEN dom IN ('sentry.io', 'example.com') THEN 'excluded_domain:' || dom WHEN valid_reason <> 'noreply' THEN valid_reason
    WHEN {starts('loc', vocab.AUTO_REPLY_PREFIXES)} THEN 'auto_reply_local_part' WHEN loc IN ({q(vocab.TECHNICAL_LOCAL_PARTS)}) THEN 'technical_local_part:' || loc WHEN generated THEN 'hash_local_part' END AS reason FROM a3)"""


def addresses(spark, sf):
    return table(spark, sf, "addresses")


@query("ext04_email_validity", with_tables("addresses", then=f"WITH {A_SQL} SELECT id, valid_reason AS reason FROM a4"))
def ext04(spark, sf):
    return addresses(spark, sf).select("id", em.email_reason(F.col("email")).alias("reason"))


@query("ext05_email_exclusion", with_tables("addresses", then=f"WITH {A_SQL} SELECT id, reason FROM a4"))
def ext05(spark, sf):
    return addresses(spark, sf).select("id", em.exclusion_reason(F.col("email"), F.col("site_domain")).alias("reason"))


@query("ext06_audit_split", with_tables("addresses", then=f"WITH {A_SQL} SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'excluded' END AS side, coalesce(split_part(reason, ':', 1), '') AS kind, count(*) AS n FROM a4 GROUP BY ALL"))
def ext06(spark, sf):
    good, bad = em.audit_split(addresses(spark, sf), F.col("site_domain"))
    rows = good.select(F.lit("accepted").alias("side"), F.lit("").alias("kind")).unionByName(bad.select(F.lit("excluded").alias("side"), F.substring_index("reason", ":", 1).alias("kind")))
    return rows.groupBy("side", "kind").agg(F.count(F.lit(1)).alias("n"))


OWN = f"""o AS (SELECT *, {labels('reg')}[1] AS tok, {tokens('maker_name')} AS mk FROM a4),
o1 AS (SELECT *, coalesce(reg = official_domain, false) AS ours, len(list_filter(mk, lambda t: t = tok OR (length(t) >= 5 AND length(tok) >= 5 AND (contains(tok, t) OR contains(t, tok))))) > 0 AS named, reg IN ({q(vocab.MAJOR_BRAND_DOMAINS)}) AS major, reg IN ({q(vocab.PERSONAL_EMAIL_DOMAINS)}) AS personal FROM o),
o2 AS (SELECT *, CASE WHEN deny IS NOT NULL THEN deny WHEN ours AND host <> reg THEN 'maker_subdomain' WHEN ours THEN 'maker_official' WHEN personal THEN 'personal_email' WHEN major THEN 'unrelated_company' WHEN named THEN 'maker_official' ELSE 'unknown' END AS owner,
  CASE WHEN deny IS NOT NULL THEN 0 WHEN ours AND host <> reg THEN 90 WHEN ours THEN 100 WHEN personal THEN 20 WHEN major AND named THEN 10 WHEN major THEN 0 WHEN named THEN 60 ELSE 0 END AS own_score FROM o1)"""


@query("ext07_ownership", with_tables("addresses", then=f"WITH {A_SQL}, {OWN} SELECT id, owner AS ownership_class, CAST(own_score AS INT) AS ownership_score FROM o2"))
def ext07(spark, sf):
    own = em.ownership(F.col("email"), F.col("maker_name"), None, F.col("official_domain"))
    return addresses(spark, sf).select("id", own["ownership_class"].alias("ownership_class"), own["ownership_score"].cast("int").alias("ownership_score"))


_TIER = "CASE " + " ".join(f"WHEN {starts('loc', p)} THEN '{n}'" for n, _, p in vocab.EMAIL_TIERS) + " ELSE 'other' END"


@query(
    "ext08_owner_and_tier",
    with_tables("addresses", then=f"""WITH {A_SQL}, t AS (SELECT *, {_TIER} AS tier FROM a4)
    SELECT id, CASE WHEN dom = 'kickstarter.com' OR coalesce(dom = site_domain, false) THEN 'platform' WHEN dom IN ('sentry.io', 'example.com') OR loc IN ({q(vocab.TECHNICAL_LOCAL_PARTS)}) OR generated OR {starts('loc', vocab.AUTO_REPLY_PREFIXES)} THEN 'monitoring'
      WHEN dom = official_domain OR dom LIKE '%.' || official_domain THEN 'maker' ELSE 'unknown' END AS owner, tier,
      CAST(least(100, CASE tier WHEN 'high' THEN 90 WHEN 'mid' THEN 60 WHEN 'low' THEN 30 ELSE 50 END + CASE WHEN dom = official_domain OR dom LIKE '%.' || official_domain THEN 10 ELSE 0 END) AS INT) AS score FROM t"""),
)
def ext08(spark, sf):
    tier, score = em.tier_and_score(F.col("email"), F.col("official_domain"))
    return addresses(spark, sf).select("id", em.email_owner(F.col("email"), F.col("official_domain"), F.col("site_domain")).alias("owner"), tier.alias("tier"), score.cast("int").alias("score"))


_PREFIXES = ", ".join(f"('{p}', {s}, '{c}')" for s, c, ps in vocab.SALES_ADDRESS_RULES for p in ps)
STARS = f"""rules(prefix, stars, category) AS (VALUES {_PREFIXES}),
ranked AS (SELECT a.id, arg_max(r.stars, length(r.prefix)) AS stars, arg_max(r.category, length(r.prefix)) AS category FROM addresses a JOIN rules r ON starts_with(lower(a.email), r.prefix) AND length(r.prefix) <= length(split_part(a.email, '@', 1)) GROUP BY a.id)"""


@query("ext09_sales_rank", with_tables("addresses", then=f"WITH {STARS} SELECT a.id, coalesce(stars, 3) AS stars, coalesce(category, 'other') AS category FROM addresses a LEFT JOIN ranked r ON a.id = r.id"))
def ext09(spark, sf):
    stars, category = em.sales_rank(F.col("email"))
    return addresses(spark, sf).select("id", stars.alias("stars"), category.alias("category"))


_EITHER = lambda words: f"(loc IN ({q(words)}) OR regexp_extract(loc, '^([^.+_-]*)', 1) IN ({q(words)}))"
ROLE = (
    f"CASE WHEN {_EITHER(vocab.EXCLUDED_ROLE_LOCALS)} THEN 'exclude' "
    + " ".join(f"WHEN label IS NOT NULL AND {has('lower(label)', t)} THEN '{r}'" for r, t in vocab.LABEL_ROLES)
    + f" WHEN {_EITHER(vocab.HIGH_ROLE_LOCALS)} THEN 'high' WHEN {_EITHER(vocab.MID_ROLE_LOCALS)} THEN 'mid' WHEN {_EITHER(vocab.SUPPORT_ROLE_LOCALS)} THEN 'support' "
    "WHEN list_has_any(regexp_split_to_array(loc, '[.+_-]'), ['jane']) THEN 'person' ELSE 'unknown' END"
)


@query("ext10_email_role", with_tables("addresses", then=f"WITH {A_SQL} SELECT id, {ROLE} AS role FROM a4"))
def ext10(spark, sf):
    person = em.person_match(F.col("email"), F.array(F.lit("Jane")))
    return addresses(spark, sf).select("id", em.email_role(F.lower("email"), F.col("label"), person).alias("role"))


@query(
    "ext11_acceptance",
    with_tables("addresses", then=f"""WITH {A_SQL}, {OWN}, x AS (SELECT *, {ROLE} AS role, list_has_any(regexp_split_to_array(loc, '[.+_-]'), ['jane']) AS person, reason IS NOT NULL AND NOT starts_with(reason, 'third_party_owner:agency') AS hard FROM o2),
    y AS (SELECT *, role <> 'exclude' AND (owner IN ('maker_official', 'maker_subdomain') OR (owner = 'personal_email' AND person)) AS acc FROM x)
    SELECT id, role, CASE WHEN acc AND NOT hard THEN 'direct' WHEN role <> 'exclude' AND NOT acc AND owner = 'agency' AND NOT hard THEN 'fallback' WHEN owner = 'unknown' AND NOT hard THEN 'unknown' ELSE 'rejected' END AS acceptance,
      acc AND role NOT IN ('exclude', 'unknown') AS sendable, CAST(CASE WHEN acc THEN CASE role WHEN 'high' THEN 0 WHEN 'person' THEN 1 WHEN 'mid' THEN 2 WHEN 'support' THEN 3 ELSE 5 END ELSE 99 END AS INT) AS rank FROM y"""),
)
def ext11(spark, sf):
    rows = addresses(spark, sf).withColumn("names", F.array(F.lit("Jane")))
    return em.classify_emails(rows, person_names="names", label="label").select("id", "role", "acceptance", "sendable", "rank")


@query(
    "ext12_email_confidence",
    with_tables("addresses", then=f"""WITH {A_SQL}, p AS (SELECT *, lower(regexp_extract(source_url, '^https?://[^/?#]*([^?#]*)', 1)) AS sp, coalesce(dom = official_domain OR dom LIKE '%.' || official_domain, false) AS ours FROM a4)
    SELECT id, CASE WHEN valid_reason IS NOT NULL THEN 'invalid' WHEN ours THEN 'high' WHEN {has('sp', ('/contact', '/about', '/support', '/impressum', '/kontakt'))} THEN 'high' WHEN {has('sp', ('/privacy', '/terms', '/legal', '/imprint'))} THEN 'medium'
      WHEN source_url <> '' THEN 'medium' ELSE 'unverified' END AS level FROM p"""),
)
def ext12(spark, sf):
    ours = F.when(em.domain_part(F.col("email")).rlike(r"(^|\.)brandworks\.com$") & F.col("official_domain").isNotNull(), "maker")
    return addresses(spark, sf).select("id", em.email_confidence(F.col("email"), ours, F.array("source_url")).alias("level"))


@query(
    "ext31_validated_candidates",
    with_tables("addresses", then=f"""WITH {A_SQL}, t AS (SELECT *, {_TIER} AS tier FROM a4 WHERE source_url <> '' AND reason IS NULL)
    SELECT project_id, email, CAST(coalesce(score, least(100, CASE tier WHEN 'high' THEN 90 WHEN 'mid' THEN 60 WHEN 'low' THEN 30 ELSE 50 END + CASE WHEN dom = official_domain OR dom LIKE '%.' || official_domain THEN 10 ELSE 0 END)) AS INT) AS score FROM t
    QUALIFY row_number() OVER (PARTITION BY project_id, addr ORDER BY id) = 1"""),
)
def ext31(spark, sf):
    return em.validate_candidates(addresses(spark, sf), position="id").select("project_id", "email", F.col("score").cast("int").alias("score"))


@query(
    "set04_ranked_contacts",
    with_tables("addresses", then=f"""WITH {STARS}, {A_SQL.replace('a4 AS (SELECT *, CASE', 'a4 AS (SELECT * EXCLUDE (site_domain), NULL AS site_domain, CASE').replace("WHEN dom = site_domain THEN 'platform_domain:' || site_domain", "")},
    b AS (SELECT * FROM a4 WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY project_id, addr ORDER BY coalesce(score, 0) DESC, position, id) = 1),
    s AS (SELECT b.*, coalesce(stars, 3) AS stars FROM b LEFT JOIN ranked r ON b.id = r.id)
    SELECT project_id, email, stars, coalesce(score, 0) AS score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY stars DESC, coalesce(score, 0) DESC, length(email), email) AS INT) AS rank FROM s"""),
)
def set04(spark, sf):
    layers = addresses(spark, sf).select("project_id", F.col("position").alias("layer_rank"), "email", "score", F.lit(None).cast("string").alias("email_owner"), F.array("source_url").alias("sources"))
    return em.rank_contacts(em.sales_contacts(layers)).select("project_id", "email", "stars", "score", "rank")


@query(
    "ext25_corroborated_domains",
    with_tables("addresses", then=f"""WITH {A_SQL}, g AS (SELECT project_id, reg AS domain, count(*) AS n_any, count(*) FILTER (WHERE source_url <> '' AND reg = 'brandworks.com') AS n_self FROM (SELECT *, {ROLE.replace("label IS NOT NULL AND ", "false AND ").replace("WHEN list_has_any(regexp_split_to_array(loc, '[.+_-]'), ['jane']) THEN 'person'", "")} AS role FROM a4) WHERE role IN ('high', 'mid', 'support') GROUP BY 1, 2)
    SELECT project_id, domain, CASE WHEN domain = 'brandworks.com' AND n_self >= 2 THEN 'site' ELSE 'siteless' END AS mode FROM g
    WHERE n_any >= 2 AND domain NOT IN ({q(vocab.PERSONAL_EMAIL_DOMAINS)}) AND ((domain = 'brandworks.com' AND n_self >= 2) OR domain = 'novalabs.co')"""),
)
def ext25(spark, sf):
    rows = addresses(spark, sf)
    found = rows.select("project_id", "email", F.array("source_url").alias("sources"), F.array().cast("array<string>").alias("terms"))
    roots = rows.select("project_id").distinct().select("project_id", F.lit("brandworks.com").alias("domain"), F.lit(True).alias("accepted"))
    dns = rows.select(urls.registrable_domain(F.col("email")).alias("domain")).distinct().withColumns({"has_a": F.col("domain") != "novalabs.co", "has_mx": F.lit(True)})
    return ct.corroborated_domains(found, roots, dns)


@query(
    "ext26_ownership_split",
    with_tables("addresses", then=f"""WITH {A_SQL}, s AS (SELECT *, source_url <> '' AS on_site, coalesce(deny, CASE WHEN reg IN ({q(vocab.MAJOR_BRAND_DOMAINS)}) THEN 'unrelated_company' ELSE 'unknown' END) AS cls FROM a4),
    r AS (SELECT id, CASE WHEN official_domain IS NULL THEN 'no_verified_official' WHEN reg = 'brandworks.com' THEN 'official_domain' WHEN reg IN ({q(vocab.PERSONAL_EMAIL_DOMAINS)}) AND on_site THEN 'personal_on_official_page'
      WHEN reg IN ({q(vocab.PERSONAL_EMAIL_DOMAINS)}) THEN 'personal_off_official_page' ELSE 'third_party:' || cls END AS owned_reason FROM s)
    SELECT id, owned_reason, owned_reason IN ('official_domain', 'personal_on_official_page') AS owned FROM r"""),
)
def ext26(spark, sf):
    rows = addresses(spark, sf).withColumn("sources", F.array("source_url"))
    none = rows.limit(0).select("project_id", F.lit("").alias("domain"), F.lit("").alias("mode"))
    return ct.ownership_split(rows, none).select("id", "owned_reason", "owned")


# --- pages --------------------------------------------------------------------------------------

EXPECTED = {0: ("'Sales@' || site_host",), 1: ("'info@' || site_host",), 2: ("'partner@' || site_host",), 3: ("'hello@' || site_host",), 4: ("'sales@maker.com'",), 5: ("'jane.doe@gmail.com'",),
            7: ("'ethan@' || site_host", "'sales@' || site_host"), 8: ("'ld@' || site_host",), 9: ("'jane@' || site_host",), 10: ("'wholesale@' || site_host",)}


def crawl_pages(spark, sf):
    return table(spark, sf, "crawl_pages")


@query(
    "ext03_page_emails",
    with_tables("crawl_pages", then="SELECT page_id, unnest(CASE variant " + " ".join(f"WHEN {k} THEN [{', '.join(v)}]" for k, v in EXPECTED.items()) + " ELSE CAST([] AS VARCHAR[]) END) AS email FROM crawl_pages"),
)
def ext03(spark, sf):
    found = em.page_emails(crawl_pages(spark, sf).select("page_id", "html"))
    return found.filter(em.exclusion_reason(F.col("email"), F.lit(None).cast("string")).isNull()).select("page_id", "email")


_BOUND = "[A-Za-z0-9._%+-]"


@query(
    "ext02_document_emails",
    f"""WITH m AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9+/=]{{80,}}', ' ', 'g') AS t FROM documents WHERE contains(text, '@')),
    x AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9._%+-])({_BOUND}{{1,64}}@[A-Za-z0-9.-]{{1,253}}[.][A-Za-z]{{2,24}})', 1)) AS e FROM m)
    SELECT DISTINCT doc_id, trim(e, '.') AS email FROM x""",
)
def ext02(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("html"))
    return em.page_emails(docs).select("doc_id", "email")


@query(
    "ext01_page_links",
    r"""WITH h AS (SELECT page_id, url, unnest(list_filter(list_transform(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(mailto:|tel:|javascript:|#)'))) AS href FROM pages),
    a AS (SELECT page_id, split_part(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE 'x' END, '#', 1) AS link FROM h)
    SELECT DISTINCT page_id, link FROM a WHERE regexp_matches(link, '^https?://')""",
)
def ext01(spark, sf):
    return sites.page_links(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "link")


@query(
    "ext13_first_socials",
    with_tables("crawl_pages", then="SELECT project_id, 'instagram' AS platform, arg_min('https://www.instagram.com/' || regexp_replace(site_host, '[.]com$', '') || '/', position) AS social_url FROM crawl_pages WHERE variant = 5 GROUP BY 1"),
)
def ext13(spark, sf):
    pages = crawl_pages(spark, sf).select("project_id", F.col("position").alias("page_position"), "url", "html")
    return sites.first_socials(sites.page_links(pages), ["project_id"], F.struct("page_position", "position"))


@query(
    "ext14_maker_forms",
    with_tables("results", then=f"""WITH {RESULTS}, d AS (SELECT *, {DENY} AS deny, rtrim(lpath, '/') AS p, coalesce(ends_with(net, official_domain), false) AS ours FROM h),
    k AS (SELECT project_id, url, reg, CASE WHEN {has('lpath', vocab.FORM_INTENTS[0][1])} THEN 'wholesale' WHEN {has('lpath', vocab.FORM_INTENTS[1][1])} THEN 'support' WHEN {has('lpath', vocab.FORM_INTENTS[2][1])} THEN 'contact' ELSE 'other' END AS intent,
      CASE WHEN ours THEN 0 ELSE 1 END AS o, CASE p {' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(vocab.FORM_PATH_ORDER))} ELSE {len(vocab.FORM_PATH_ORDER)} END AS pr FROM d
      WHERE NOT {under('host', vocab.NON_OFFICIAL_PLATFORMS)} AND NOT {has('lpath', vocab.UTILITY_FORM_PATHS)} AND deny IS NULL),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY project_id, reg, intent ORDER BY o, pr, length(url), url) = 1)
    SELECT project_id, url AS form_url, intent, CAST(row_number() OVER (PARTITION BY project_id ORDER BY o, pr, length(url), url) AS INT) AS position FROM b"""),
)
def ext14(spark, sf):
    return sites.maker_forms(results(spark, sf).select("project_id", F.col("url").alias("form_url"), "official_domain"))


@query(
    "ext15_documents",
    with_tables("crawl_pages", then="SELECT page_id, 'https://www.' || site_host || CASE WHEN position IN (1, 4, 6) THEN '/docs/Catalog-2024.pdf' ELSE '/docs/Catalog-2024.pdf' END AS link, 'Catalog-2024.pdf' AS label, true AS relevant FROM crawl_pages WHERE variant = 6"),
)
def ext15(spark, sf):
    links = sites.page_links(crawl_pages(spark, sf).select("page_id", "url", "html"))
    return sites.document_links(links).select("page_id", "link", "label", "relevant")


@query(
    "ext16_official_link",
    with_tables("crawl_pages", then="SELECT page_id, 'https://shop.' || site_host AS official_link, CAST(90 AS INT) AS score FROM crawl_pages WHERE variant = 6"),
)
def ext16(spark, sf):
    pages = crawl_pages(spark, sf).select("page_id", "url", "html", F.array(F.lit("shop")).alias("terms"))
    return sites.official_link(sites.page_anchors(pages), ["page_id"]).select("page_id", "official_link", F.col("score").cast("int").alias("score"))


@query(
    "ext19_site_identity",
    with_tables("crawl_pages", then="""SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g') AS title,
      CASE WHEN variant = 8 THEN 'Brand Works' END AS org_name, CASE WHEN variant = 8 THEN 'Organization' ELSE '' END AS ld_types, site_host AS registered_domain FROM crawl_pages"""),
)
def ext19(spark, sf):
    rows = sites.site_identity(crawl_pages(spark, sf).select("page_id", "url", "html"))
    return rows.select("page_id", F.coalesce("title", F.lit("")).alias("title"), "org_name", joined("ld_types"), "registered_domain")


def identified(spark, sf):
    pages = crawl_pages(spark, sf).select("page_id", "project_id", "url", "html")
    context = table(spark, sf, "crawl_projects").select(F.col("id").alias("project_id"), "maker_name", F.col("title").alias("product_name"), em.site_email_domain(F.col("source_site")).alias("site_domain"))
    rows = sites.site_identity(pages).join(context, "project_id")
    return rows.withColumn("terms", tx.significant_terms(F.concat_ws(" ", "product_name", "maker_name")))


@query("ext20_candidate_verdict")
def ext20(spark, sf):
    return sites.candidate_verdict(identified(spark, sf)).select("page_id", "verdict", "verdict_confidence", "site_role", joined("signals"))


@query("ext21_collisions")
def ext21(spark, sf):
    return sites.collision_check(identified(spark, sf)).select("page_id", "collision", "collision_reason", "collision_confidence")


@query("ext21_host_collisions")
def ext21b(spark, sf):
    rows = results(spark, sf).withColumns({"html": F.concat(F.lit("<title>"), "title", F.lit("</title>")), "terms": tx.significant_terms(F.concat_ws(" ", "maker_name", F.lit("aurora lamp")))})
    return sites.collision_check(sites.site_identity(rows)).select("id", "collision", "collision_reason", "collision_confidence")


@query(
    "ext27_people",
    with_tables("crawl_pages", then="""SELECT page_id, unnest(['Jane Miller', 'Tom Hardy']) AS name, unnest(['CEO', 'Sales']) AS department, unnest([70, 85]) AS priority FROM crawl_pages WHERE variant = 9"""),
)
def ext27(spark, sf):
    texts = crawl_pages(spark, sf).select(F.col("page_id").alias("project_id"), "url", tx.strip_markup(F.col("html")).alias("text"), F.col("site_host").alias("official_domain"))
    return ct.people_on_pages(texts).select(F.col("project_id").alias("page_id"), "name", "department", "priority")


@query("ext28_capture_records")
def ext28(spark, sf):
    pages = crawl_pages(spark, sf).select(F.col("page_id").alias("capture_id"), "project_id", "url", F.col("html").alias("content"))
    return ct.capture_records(pages).select("capture_id", "email", "reason", "region", "method", "confidence")


@query("ext34_contact_summary")
def ext34(spark, sf):
    pages = crawl_pages(spark, sf).select("project_id", "position", "url", "html")
    rows = ct.contact_summary(pages, table(spark, sf, "crawl_projects"))
    return rows.select("project_id", "primary_email", "n_emails", "primary_form", "n_forms", "press_page", "wholesale_page", "official_site", "confidence", "contactability_score", "recommended_channel")


@query(
    "ext29_contactability",
    with_tables("results", then="""WITH f AS (SELECT id, CASE position % 5 WHEN 0 THEN ['high'] WHEN 1 THEN ['mid', 'low'] WHEN 2 THEN ['other'] ELSE CAST([] AS VARCHAR[]) END AS t, position % 3 = 0 AS form, position % 4 = 1 AS li, position % 6 = 2 AS ig, official_domain IS NOT NULL AS site FROM results),
    v AS (SELECT *, list_filter([CASE WHEN list_contains(t, 'high') THEN 95 END, CASE WHEN list_contains(t, 'mid') OR list_contains(t, 'other') THEN 80 END, CASE WHEN list_contains(t, 'low') THEN 60 END, CASE WHEN form THEN 70 END, CASE WHEN li THEN 60 END, CASE WHEN ig THEN 45 END], lambda x: x IS NOT NULL) AS vals FROM f)
    SELECT id, CAST(CASE WHEN len(vals) = 0 THEN CASE WHEN site THEN 25 ELSE 5 END ELSE least(100, list_max(vals) + (len(vals) - 1) * 5) END AS INT) AS score,
      CASE WHEN len(t) > 0 THEN 'email' WHEN form THEN 'contact_form' WHEN li THEN 'linkedin' WHEN ig THEN 'instagram' ELSE 'manual_research' END AS channel FROM v"""),
)
def ext29(spark, sf):
    n = F.col("position")
    tiers = F.when(n % 5 == 0, F.array(F.lit("high"))).when(n % 5 == 1, F.array(F.lit("mid"), F.lit("low"))).when(n % 5 == 2, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    socials = F.map_from_entries(F.array(F.struct(F.lit("linkedin"), F.when(n % 4 == 1, "u")), F.struct(F.lit("instagram"), F.when(n % 6 == 2, "u"))))
    none = F.lit(None).cast("string")
    rows = results(spark, sf)
    return rows.select("id", ct.contactability(tiers, n % 3 == 0, socials, F.col("official_domain").isNotNull()).cast("int").alias("score"), ct.recommended_channel(tiers, n % 3 == 0, socials, none, none).alias("channel"))


@query(
    "ext30_channel_ranking",
    with_tables("addresses", then=f"""WITH {STARS}, m AS (SELECT project_id, 'email' AS channel, email AS target, CAST(least(100, greatest(20, CASE WHEN label = 'Press & Influencers' THEN 100 WHEN label = 'Reseller' THEN 55 ELSE 70 END + (coalesce(stars, 3) - 3) * 4)) AS INT) AS score, 1 AS priority FROM addresses a LEFT JOIN ranked r ON a.id = r.id WHERE position < 2),
    c AS (SELECT DISTINCT project_id, CASE WHEN position = 3 THEN 'contact_form' WHEN position = 4 THEN 'tiktok' ELSE 'linkedin_person' END AS channel, source_url AS target FROM addresses WHERE position IN (3, 4, 5) AND source_url <> ''),
    u AS (SELECT * FROM m UNION ALL SELECT project_id, channel, target, CASE channel WHEN 'contact_form' THEN 82 WHEN 'tiktok' THEN 42 ELSE 72 END, CASE channel WHEN 'contact_form' THEN 2 WHEN 'tiktok' THEN 6 ELSE 4 END FROM c)
    SELECT project_id, channel, score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY priority, score DESC, channel, target) AS INT) AS position FROM u"""),
)
def ext30(spark, sf):
    rows = addresses(spark, sf)
    kind = F.when(F.col("label") == "Press & Influencers", "contact_page").when(F.col("label") == "Reseller", "legal").otherwise("x")
    mails = rows.filter("position < 2").select("project_id", "email", kind.alias("source_kind"))
    name = F.when(F.col("position") == 3, "contact_form").when(F.col("position") == 4, "tiktok").otherwise("linkedin_person")
    channels = rows.filter("position IN (3, 4, 5)").select("project_id", name.alias("channel"), F.col("source_url").alias("target")).distinct()
    queries = rows.filter("position = 9").select("project_id", F.col("email").alias("query"), "position")
    found = mails.select("project_id").unionByName(channels.filter("target <> ''").select("project_id")).distinct()
    ranked = ct.channel_ranking(mails, channels, queries).join(found, "project_id", "left_semi")
    return ranked.select("project_id", "channel", F.col("score").cast("int").alias("score"), "position")


@query(
    "ext33_evidence_score",
    with_tables("results", then="""SELECT id, CAST(least(100, CASE WHEN position % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN position % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN position % 5 = 0 THEN 15 ELSE 0 END + CASE WHEN official_domain IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN position % 7 = 0 THEN 15 ELSE 0 END) AS INT) AS score,
      CASE WHEN position % 4 = 0 THEN 'Google Workspace' WHEN position % 4 = 1 THEN 'Microsoft 365' WHEN position % 4 = 2 THEN 'Other' ELSE '' END AS mail_host FROM results"""),
)
def ext33(spark, sf):
    n = F.col("position")
    one = lambda k: F.when(n % k == 0, 1).otherwise(0)
    socials = F.map_from_entries(F.array(F.struct(F.lit("instagram"), F.when(n % 5 == 0, "u"))))
    mx = F.when(n % 4 == 0, F.array(F.lit("aspmx.l.google.com"))).when(n % 4 == 1, F.array(F.lit("x.mail.protection.outlook.com"))).when(n % 4 == 2, F.array(F.lit("mx.host.net"))).otherwise(F.array().cast("array<string>"))
    return results(spark, sf).select("id", ct.evidence_score(one(2), one(3), socials, F.col("official_domain").isNotNull(), one(7)).cast("int").alias("score"), ct.mail_host_class(mx).alias("mail_host"))


# --- text functions ----------------------------------------------------------------------------------

@query(
    "txt05_short_titles",
    with_tables("projects", then="""SELECT id, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_extract(title, '^(.*?)(?:\\s[-–—|｜:：]\\s|[:：|｜–—]|$)', 1), '[(（\\[【].*?[)）\\]】]', '', 'g'), '\\s+', ' ', 'g')), '[ -–—|｜:：]') AS short FROM projects""".replace("trim(regexp_replace(trim(", "(regexp_replace(trim(").replace(", '[ -–—|｜:：]') AS short", ", '^[ –—|｜:：-]+|[ –—|｜:：-]+$', '', 'g')) AS short")),
)
def txt05(spark, sf):
    return table(spark, sf, "projects").select("id", tx.short_title(F.col("title")).alias("short"))


@query(
    "txt08_name_script",
    "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 'no_maker_name' WHEN length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 0.6 THEN 'latin' ELSE 'non_latin' END AS script FROM documents",
)
def txt08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.name_script(F.col("text")).alias("script"))


@query("txt07_plain_queries", "SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS query FROM documents")
def txt07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.plain_punctuation(nfkc(F.col("text"))).alias("query"))


@query(
    "txt11_reply_labels",
    with_tables("replies", then=f"""WITH l AS (SELECT *, lower(body) AS low FROM replies),
    s AS (SELECT *, CASE {' '.join(f"WHEN {has('low', w)} THEN '{n}'" for n, w in vocab.REPLY_INTENTS)} ELSE 'unclear' END AS intent, {' + '.join(f"CASE WHEN contains(low, '{w.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for w in vocab.NEGATIVE_REPLY)} AS neg,
      {' + '.join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in vocab.POSITIVE_REPLY)} AS pos FROM l),
    t AS (SELECT *, CASE WHEN neg > pos THEN 'negative' WHEN pos > 0 THEN 'positive' ELSE 'neutral' END AS sentiment FROM s)
    SELECT conv_id, turn, intent, sentiment, CASE WHEN regexp_matches(body, '[぀-ヿ一-鿿]') THEN 'ja' ELSE 'en' END AS language, CASE WHEN intent = 'unclear' THEN 'low' WHEN sentiment = 'neutral' THEN 'medium' ELSE 'high' END AS confidence FROM t"""),
)
def txt11(spark, sf):
    labels_ = tx.reply_labels(F.col("body"), vocab.REPLY_INTENTS, vocab.POSITIVE_REPLY, vocab.NEGATIVE_REPLY)
    return table(spark, sf, "replies").select("conv_id", "turn", *[c.alias(n) for n, c in labels_.items()])


@query("txt01_page_text")
def txt01(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))



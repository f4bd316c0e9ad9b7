"""Links, socials, forms, documents and official-site checks over a pages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom import vocab
from leadloom.functions import urls
from leadloom.functions.binding import let, let_all
from leadloom.functions.pandas_udfs import jsonld_facts, unescape_entities
from leadloom.functions.text import any_of, contains_any, quote_regex, significant_terms, squash, unique_ignoring_case
from leadloom.functions.urls import lit_array
from leadloom.operators.emails import deny_class, name_matches_domain

STRINGS = "array<string>"


def _strings() -> Column:
    return F.array().cast(STRINGS)


# --- links -------------------------------------------------------------------------------

def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of a link on a page, dot segments removed."""

    def join(v):
        base, href, root, path = v["base"], v["href"], v["root"], v["path"]
        folder = F.regexp_replace(path, r"[^/]*$", "")
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(urls.scheme(base), F.lit(":"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(root, href))
            .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
            .when(folder == "", F.concat(root, F.lit("/"), href))
            .otherwise(F.concat(root, folder, href))
        )

    joined = let_all({"base": base, "href": href, "root": urls.root_url(base), "path": urls.path(base)}, join)
    return let(joined, lambda u: F.when(urls.path(u).rlike(r"/\.{1,2}(/|$)"), _without_dots(u)).otherwise(u))


def _without_dots(url: Column) -> Column:
    parts = F.slice(F.split(urls.path(url), "/"), 2, 10_000)
    last = F.element_at(parts, -1)
    walked = F.aggregate(
        parts,
        _strings(),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, seg)),
    )
    closed = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    tail = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    return F.concat(urls.root_url(url), F.lit("/"), F.array_join(closed, "/"), tail)


def _usable(href: Column) -> Column:
    return (href != "") & ~href.rlike(r"^(mailto:|tel:|javascript:|#)")


def page_links_of(html: Column, base: Column) -> Column:
    """Distinct absolute http(s) links of a page in order, without fragments."""
    hrefs = F.transform(
        F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda h: F.trim(h)
    )
    absolute = F.transform(
        F.filter(hrefs, _usable), lambda h: F.substring_index(resolve_url(base, h), "#", 1)
    )
    return F.array_distinct(F.filter(absolute, lambda u: u.rlike(r"^https?://")))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per page and link: ``…, position, link``."""
    kept = [c for c in pages.columns if c != "html"]
    rows = pages.select(*kept, F.posexplode_outer(page_links_of(F.col("html"), F.col("url"))).alias("position", "link"))
    return rows.filter(F.col("link").isNotNull())


ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']+)["'][^>]*?>(.*?)</a>"""


def page_anchors(pages: DataFrame) -> DataFrame:
    """One row per anchor with its lower-cased text: ``…, position, link, text``."""
    kept = [c for c in pages.columns if c != "html"]
    rows = pages.select(*kept, F.posexplode_outer(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("position", "anchor"))
    href = F.trim(F.regexp_extract("anchor", ANCHOR, 1))
    label = F.regexp_replace(F.regexp_extract("anchor", ANCHOR, 2), r"<[^>]+>", "")
    rows = rows.withColumns({"href": href, "text": F.lower(squash(label))}).filter(_usable(F.col("href")))
    link = F.substring_index(resolve_url(F.col("url"), F.col("href")), "#", 1)
    return rows.withColumn("link", link).filter(F.col("link").rlike(r"^https?://")).drop("anchor", "href")


# --- socials -------------------------------------------------------------------------------

def social_platforms(link: Column) -> Column:
    """Platforms a link belongs to; none for sharing links and the platforms' own accounts."""
    hits = F.array_compact(
        F.array(*[F.when(link.rlike("(?i)" + pattern), F.lit(name)) for name, pattern in vocab.SOCIAL_HOSTS.items()])
    )
    bad = link.rlike("(?i)" + vocab.SOCIAL_SHARE_PATTERN) | urls.is_platform_account(link)
    return F.when(bad, _strings()).otherwise(hits)


def first_socials(links: DataFrame, keys, order) -> DataFrame:
    """First link per platform and key, as rows ``…, platform, social_url``."""
    rows = links.withColumn("platform", F.explode(social_platforms(F.col("link"))))
    return rows.groupBy(*keys, "platform").agg(F.min_by("link", order).alias("social_url"))


def korean_channels(text: Column) -> Column:
    """First address on a host of each channel, without its query."""
    links = F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s\"'<>]+)"))
    found = F.transform(links, lambda u: F.struct(urls.netloc(u).alias("host"), u.alias("url")))
    found = F.filter(found, lambda x: F.length(urls.path(x["url"])) > 1)

    def first(hosts) -> Column:
        return F.get(F.filter(found, lambda x: x["host"].isin(*hosts)), F.lit(0))["url"]

    entries = [F.struct(F.lit(k).alias("key"), F.substring_index(first(hosts), "?", 1).alias("value")) for k, hosts in vocab.KOREAN_CHANNELS.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def social_profile(platform: Column, url: Column) -> Column:
    """Canonical profile URL, NULL when the link is no profile."""
    net = urls.netloc(url)
    seg = F.filter(F.split(urls.path(url), "/"), lambda s: s != "")
    first, second = F.get(seg, 0), F.get(seg, 1)
    low = F.lower(first)
    instagram = F.when(
        F.contains(net, F.lit("instagram.com"))
        & ~low.isin(*vocab.INSTAGRAM_NON_PROFILE)
        & first.rlike(r"^[A-Za-z0-9_.]+$"),
        F.concat(F.lit("https://www.instagram.com/"), first, F.lit("/")),
    )
    profile_id = F.nullif(F.regexp_extract(url, r"[?&]id=([^&#]+)", 1), F.lit(""))
    facebook = F.when(
        F.contains(net, F.lit("facebook.com")) & ~low.isin(*vocab.FACEBOOK_NON_PROFILE),
        F.when(low == "profile.php", F.concat(F.lit("https://www.facebook.com/profile.php?id="), profile_id))
        .when((low == "pages") & second.isNotNull(), F.concat(F.lit("https://www.facebook.com/"), F.array_join(F.slice(seg, 1, 3), "/")))
        .when(first.rlike(r"^[A-Za-z0-9_.\-]+$"), F.concat(F.lit("https://www.facebook.com/"), first)),
    )
    linkedin = F.when(
        F.contains(net, F.lit("linkedin.com")) & second.isNotNull(),
        F.when(low.isin("company", "school", "showcase"), F.concat(F.lit("https://www.linkedin.com/company/"), second, F.lit("/")))
        .when(low == "in", F.concat(F.lit("https://www.linkedin.com/in/"), second, F.lit("/"))),
    )
    return (
        F.when(platform == "instagram", instagram)
        .when(platform == "facebook", facebook)
        .when(platform == "linkedin", linkedin)
        .when(~url.rlike("(?i)" + vocab.SOCIAL_SHARE_PATTERN), url)
    )


def social_handle(platform: Column, url: Column) -> Column:
    seg = F.filter(F.split(urls.path(social_profile(platform, url)), "/"), lambda s: s != "")
    return F.lower(F.when(platform == "linkedin", F.get(seg, 1)).otherwise(F.get(seg, 0)))


def is_platform_profile(platform: Column, url: Column) -> Column:
    handle = social_handle(platform, url)
    return F.coalesce(handle.isin(*vocab.PLATFORM_HANDLES), F.lit(False)) | contains_any(F.lower(urls.path(url)), vocab.PLATFORM_HANDLES)


def linkedin_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(
        F.contains(low, F.lit("linkedin.com")),
        F.when(contains_any(low, ("/company/", "/school/")), "company").when(contains_any(low, ("/in/", "/pub/")), "person"),
    )


# --- page kinds -------------------------------------------------------------------------------

def path_kind(url: Column) -> Column:
    p = F.rtrim(F.lower(urls.path(url)), F.lit("/"))
    return (
        F.when(p == "", "root")
        .when(contains_any(p, ("contact", "support", "help", "impressum", "kontakt", "customer-service", "inquiry")), "contact")
        .when(contains_any(p, ("about", "company", "team", "our-story", "who-we-are")), "about")
        .when(contains_any(p, ("privacy", "terms", "legal", "imprint", "policy")), "legal")
        .otherwise("other")
    )


def page_type(url: Column, official_domain: Column) -> Column:
    p = F.lower(urls.path(url))
    ours = F.coalesce((official_domain != "") & F.endswith(urls.netloc(url), official_domain), F.lit(False))
    return (
        F.when(ours & p.isin("", "/"), "official_site")
        .when(contains_any(p, vocab.PRESS_PATH_HINTS), "press")
        .when(contains_any(p, vocab.WHOLESALE_PATH_HINTS), "wholesale")
        .when(contains_any(p, vocab.CONTACT_PATH_HINTS), "contact")
        .when(F.contains(p, F.lit("about")), "about")
        .when(ours, "official_site")
        .otherwise("search_result")
    )


# --- forms and documents -------------------------------------------------------------------------

def at_most(rows: DataFrame, limit: int | None) -> DataFrame:
    """Rows up to a position, all of them without a limit."""
    return rows if limit is None else rows.filter(F.col("position") <= limit)


def maker_forms(forms: DataFrame, limit: int | None = None) -> DataFrame:
    """``forms(project_id, form_url, official_domain)`` to the maker's own forms, best
    first: one per domain and intent, at most ``limit`` per project."""
    f = F.col("form_url")
    ok = (
        ~F.contains(f, F.lit("@"))
        & ~urls.is_platform_url(f)
        & ~urls.is_utility_form(f)
        & ~F.coalesce(deny_class(f).isin(*vocab.THIRD_PARTY_CLASSES), F.lit(False))
    )
    ours = F.coalesce((F.col("official_domain") != "") & F.endswith(urls.netloc(f), F.col("official_domain")), F.lit(False))
    rank = F.struct(
        F.when(ours, 0).otherwise(1).alias("official_first"),
        urls.form_path_rank(f).alias("path_rank"),
        F.length(f).alias("length"),
        f.alias("url"),
    )
    best = (
        forms.filter(ok)
        .withColumns({"domain": urls.registrable_domain(f), "intent": urls.form_intent(f), "form_rank": rank})
        .groupBy("project_id", "domain", "intent")
        .agg(F.min("form_rank").alias("form_rank"))
    )
    w = Window.partitionBy("project_id").orderBy("form_rank")
    rows = at_most(best.withColumn("position", F.row_number().over(w)), limit)
    return rows.select("project_id", F.col("form_rank.url").alias("form_url"), "intent", "position")


def document_links(links: DataFrame) -> DataFrame:
    """PDF links with a label and whether the name promises something useful."""
    low = F.lower(F.col("link"))
    label = F.nullif(F.element_at(F.split(urls.path(F.col("link")), "/"), -1), F.lit(""))
    return links.filter(F.contains(low, F.lit(".pdf"))).withColumns(
        {"label": F.coalesce(label, F.lit("PDF")), "relevant": contains_any(low, vocab.PDF_KEYWORDS)}
    )


# --- official links -------------------------------------------------------------------------------

def embedded_websites(html: Column) -> Column:
    """URLs of the embedded ``"websites":[…]`` list: NULL without a list, empty when the
    list is there and empty. ``html`` must be entity-decoded."""
    arrays = F.regexp_extract_all(html, F.lit(r'(?s)"websites"\s*:\s*\[(.*?)\]'), F.lit(1))
    found = F.flatten(F.transform(arrays, lambda a: F.regexp_extract_all(a, F.lit(r"""https?://[^\s"'\\<>]+"""), F.lit(0))))
    cleaned = F.transform(found, lambda u: F.trim(F.regexp_replace(u, r'[",\\]+$', "")))
    first = let(F.filter(cleaned, lambda u: u != ""), unique_ignoring_case)
    return F.when(F.size(arrays) > 0, first)


def official_from_websites(websites: Column) -> Column:
    def ok(u):
        host = urls.netloc(u)
        return u.rlike(r"^https?://[^/?#]") & ~urls.is_platform_url(u) & ~contains_any(
            host, vocab.NON_OFFICIAL_HOSTS + vocab.INFRASTRUCTURE_HOST_HINTS
        )

    return urls.root_url(F.get(F.filter(websites, ok), 0))


def official_link_candidates(anchors: DataFrame, terms: str = "terms") -> DataFrame:
    """Outbound anchors of campaign pages with their evidence score."""
    link, text = F.col("link"), F.col("text")
    dom = urls.domain_of(link)
    token = F.substring_index(dom, ".", 1)
    bare = F.trim(F.trim(F.regexp_replace(text, r"https?://|www\.", "")), F.lit("/"))
    score = (
        F.when(contains_any(text, vocab.OFFICIAL_ANCHOR_WORDS), 50).otherwise(0)
        + F.when((token != "") & F.exists(F.col(terms), lambda t: F.contains(token, t) | F.contains(t, token)), 40).otherwise(0)
        + F.when((bare != "") & ((bare == dom) | (F.substring_index(bare, "/", 1) == dom)), 45).otherwise(0)
    )
    outside = (
        ~urls.is_platform_url(link)
        & ~contains_any(urls.netloc(link), vocab.NON_OFFICIAL_HOSTS)
        & (dom != "")
        & (dom != urls.domain_of(F.col("url")))
    )
    return anchors.filter(outside).withColumn("score", score)


def official_link(anchors: DataFrame, keys, terms: str = "terms") -> DataFrame:
    """Best outbound link per page with a score of at least 40; the first wins a tie."""
    rows = official_link_candidates(anchors, terms).filter(F.col("score") >= 40)
    best = F.struct(F.col("score"), (-F.col("position")).alias("first"))
    return rows.groupBy(*keys).agg(F.max_by(urls.root_url(F.col("link")), best).alias("official_link"), F.max("score").alias("score"))


def confirm_official(
    url: Column, *, maker_name: Column, product_title: Column, direct_linked: Column, jsonld_org: Column, site_name: Column
) -> dict[str, Column]:
    """Evidence for a site: two independent pieces accept it, one leaves it uncertain."""
    ok = urls.official_site_or_none(url)
    token = F.substring_index(urls.domain_of(url), ".", 1)
    maker = significant_terms(F.coalesce(maker_name, F.lit("")))
    terms = significant_terms(F.concat_ws(" ", maker_name, product_title))
    shares = lambda name: F.coalesce(F.arrays_overlap(significant_terms(F.coalesce(name, F.lit(""))), maker), F.lit(False))
    pieces = F.array_compact(
        F.array(
            F.when((token != "") & F.exists(terms, lambda t: F.contains(t, token) | F.contains(token, t)), F.lit("domain")),
            F.when(shares(site_name), F.lit("site_name")),
            F.when(shares(jsonld_org), F.lit("jsonld_org")),
            F.when(F.coalesce(direct_linked, F.lit(False)), F.lit("direct_link")),
        )
    )
    points = {"domain": 40, "site_name": 35, "jsonld_org": 35, "direct_link": 30}
    score = sum((F.when(F.array_contains(pieces, k), v).otherwise(0) for k, v in points.items()), F.lit(0))
    refused = ok.isNull()
    empty = _strings()
    return {
        "decision": F.when(refused, "rejected").when(F.size(pieces) >= 2, "accepted").otherwise("uncertain"),
        "score": F.when(refused, 0).otherwise(score),
        "evidence": F.when(refused, empty).otherwise(pieces),
    }


def site_to_store(candidate: Column, decision: Column, evidence: Column, current: Column) -> Column:
    """A valid stored site stays; a candidate without any evidence is not stored."""
    keep = urls.official_site_or_none(current)
    usable = (decision != "rejected") & (F.size(evidence) > 0)
    return F.coalesce(keep, F.when(usable, candidate))


# --- identity -------------------------------------------------------------------------------------

TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def meta_property(html: Column, prop: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"""(?i)<meta[^>]+property=["']{quote_regex(prop)}["'][^>]+content=["']([^"']*)""", 1), F.lit(""))


def jsonld_blocks(html: Column) -> Column:
    pattern = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def site_identity(pages: DataFrame) -> DataFrame:
    """Adds title, site_name, og_type, canonical_url, JSON-LD facts, registered_domain and
    the token set of all names. Other columns, ``html`` included, stay."""
    html = F.coalesce(F.col("html"), F.lit(""))
    raw_title = squash(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"<[^>]+>", ""))
    canonical = F.nullif(F.trim(F.regexp_extract(html, r"""(?i)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)""", 1)), F.lit(""))
    rows = pages.withColumns(
        {
            "_ld": jsonld_facts(jsonld_blocks(html)),
            "title": F.nullif(F.trim(unescape_entities(raw_title)), F.lit("")),
            "site_name": F.nullif(F.trim(unescape_entities(meta_property(html, "og:site_name"))), F.lit("")),
            "og_type": F.lower(F.trim(meta_property(html, "og:type"))),
            "canonical_url": canonical,
        }
    )
    names = F.concat(F.array_compact(F.array("title", "site_name")), F.col("_ld.site_names"))
    rows = rows.withColumns(
        {
            "names": names,
            "organization_names": F.col("_ld.organization_names"),
            "ld_types": F.col("_ld.types"),
            "org_name": F.col("_ld.org_name"),
            "legal_name": F.col("_ld.legal_name"),
            "org_count": F.col("_ld.org_count"),
            "registered_domain": urls.registrable_domain(F.coalesce(F.col("canonical_url"), F.col("url"))),
        }
    )
    return rows.withColumn(
        "identity_tokens", significant_terms(F.concat_ws(" ", F.col("names"), F.col("organization_names")))
    ).drop("_ld")


def _host_rules(url: Column, domains=(), brands=(), prefixes=()) -> Column:
    host = urls.strip_www(F.rtrim(urls.hostname(url), F.lit(".")))
    tests = [urls.under_any(host, domains)]
    if brands:
        tests.append(urls.domain_token(host).isin(*brands))
    tests += [(host == p) | F.startswith(host, F.lit(p + ".")) for p in prefixes]
    return any_of(tests)


def host_group(url: Column) -> Column:
    """marketplace, blog, directory or news, in that order; NULL for any other host."""
    v = vocab
    return (
        F.when(_host_rules(url, v.MARKETPLACE_DOMAINS, v.MARKETPLACE_BRANDS, v.MARKETPLACE_PREFIXES), "marketplace")
        .when(_host_rules(url, v.BLOG_PLATFORMS), "blog")
        .when(_host_rules(url, v.DIRECTORY_DOMAINS, v.DIRECTORY_BRANDS), "directory")
        .when(_host_rules(url, v.NEWS_DOMAINS, v.NEWS_BRANDS, v.NEWS_PREFIXES), "news")
    )


def _contains_either(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def mentions_reseller(text: Column) -> Column:
    """Reseller wording that is not just an official-store phrase."""
    low = F.lower(text)
    stores = "|".join(quote_regex(w.lower()) for w in sorted(vocab.OFFICIAL_STORE_WORDS, key=len, reverse=True))
    stripped = F.regexp_replace(low, stores, " ")
    return F.coalesce(contains_any(low, vocab.RESELLER_WORDS) & contains_any(stripped, vocab.RESELLER_WORDS), F.lit(False))


def _split_title(text: Column, maker: Column) -> Column:
    """``Brand | somebody else``: the maker appears in some but not all parts."""
    parts = F.filter(F.split(text, vocab.IDENTITY_SEPARATORS), lambda s: F.trim(s) != "")
    hits = F.size(F.filter(parts, lambda s: _contains_either(s, maker)))
    return F.coalesce((F.size(parts) >= 2) & (hits > 0) & (hits < F.size(parts)), F.lit(False))


def candidate_verdict(identified: DataFrame, *, maker_name="maker_name", product_name="product_name", site_domain="site_domain") -> DataFrame:
    """Adds ``verdict`` (rejected, official, candidate), ``verdict_confidence``,
    ``site_role`` and ``signals`` to pages with identity columns."""
    url, maker = F.col("url"), F.col(maker_name)
    token = F.substring_index(urls.strip_www(urls.hostname(url)), ".", 1)
    texts = [F.col("site_name"), F.col("org_name"), F.col("title")]
    blob = F.lower(F.concat_ws(" ", *texts))
    terms = lambda c: significant_terms(F.coalesce(c, F.lit("")))
    s1 = F.coalesce(name_matches_domain(token, terms(maker)), F.lit(False))
    s2 = any_of([_contains_either(t, maker) for t in texts])
    s3 = F.exists(terms(F.col(product_name)), lambda t: F.contains(blob, t))
    s4 = F.col("org_count") > 0
    group = host_group(url)
    own = F.coalesce((F.col(site_domain) != "") & F.contains(urls.hostname(url), F.col(site_domain)), F.lit(False))
    refused = group.isNotNull() | own | (F.coalesce(F.col("html"), F.lit("")) == "")
    high = (s2 & (s1 | s3 | s4)) | (s1 & s4)
    medium = s2 | (s1 & s3) | (s3 & s4)
    reseller = any_of([mentions_reseller(t) for t in texts]) | any_of([_split_title(t, maker) for t in texts])
    demoted = ~s1 & reseller
    official = (high | medium) & ~demoted
    return identified.withColumns(
        {
            "verdict": F.when(refused, "rejected").when(official, "official").otherwise("candidate"),
            "verdict_confidence": F.when(refused | ~official, "low").when(high, "high").otherwise("medium"),
            "site_role": F.when(group == "blog", "blog").when(refused, "unknown").when((high | medium) & demoted, "reseller_like").when(official, "maker").otherwise("unknown"),
            "signals": F.array_compact(F.array(F.when(s1, F.lit("domain")), F.when(s2, F.lit("maker_name")), F.when(s3, F.lit("product")), F.when(s4, F.lit("organisation")))),
        }
    )


# --- collisions ---------------------------------------------------------------------------------

def _present(pool: Column, names: Column) -> Column:
    """A name token equals a pool token, or from four letters on one contains the other."""
    return F.exists(
        names,
        lambda n: (F.length(n) >= 3)
        & F.exists(pool, lambda p: (p == n) | ((F.length(n) >= 4) & (F.contains(p, n) | F.contains(n, p)))),
    )


def person_name_tokens(maker: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.coalesce(maker, F.lit("")), F.lit(r"[A-Za-z][A-Za-z'\-]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def is_person_name(maker: Column) -> Column:
    tokens = person_name_tokens(maker)
    company = F.arrays_overlap(F.transform(tokens, F.lower), lit_array(vocab.COMPANY_WORDS))
    shouted = F.exists(tokens, lambda t: F.upper(t) == t)
    return F.size(tokens).between(2, 3) & ~company & ~shouted


def collision_check(identified: DataFrame, *, maker_name="maker_name", terms="terms") -> DataFrame:
    """Rejects sites that clearly belong to somebody else; silence is not evidence.

    Adds ``collision`` (bool), ``collision_reason`` and ``collision_confidence``.
    """
    c = F.col
    url, maker, html = c("url"), c(maker_name), F.coalesce(c("html"), F.lit(""))
    reg = urls.registrable_domain(url)
    low = F.lower(html)
    name_terms = significant_terms(F.coalesce(maker, F.lit("")))
    domain_tokens = significant_terms(F.replace(reg, F.lit("."), F.lit(" ")))
    staged = identified.withColumns(
        {
            "_reg": reg,
            "_deny": deny_class(url),
            "_names": name_terms,
            "_pool": F.array_union(c("identity_tokens"), domain_tokens),
            "_types": F.transform(c("ld_types"), F.lower),
            "_tokens": F.array_union(c("identity_tokens"), domain_tokens),
        }
    )
    named = F.coalesce(_present(c("_pool"), c("_names")), F.lit(False))
    host = urls.host_of(url)
    institution = host.rlike("(?i)" + vocab.INSTITUTION_HOST_PATTERN) & ~_present(
        significant_terms(F.replace(host, F.lit("."), F.lit(" "))), c("_names")
    )
    strong_words = [w for w in vocab.MEDIA_WORDS if w not in vocab.MEDIA_WEAK_WORDS]
    media = ~named & (
        F.arrays_overlap(c("_types"), lit_array(vocab.MEDIA_TYPES))
        | F.coalesce(c("og_type") == "article", F.lit(False))
        | F.arrays_overlap(c("_tokens"), lit_array(strong_words))
    )
    count_of = lambda words: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    agency = ~named & (F.arrays_overlap(c("_types"), lit_array(vocab.AGENCY_TYPES)) | (count_of(vocab.AGENCY_PHRASES) >= 2))
    feed = html.rlike(r"(?i)application/(?:rss|atom)\+xml")
    bylines = F.regexp_count(html, F.lit(r"\bby\s+[A-Z][a-z]+"))
    words = count_of(vocab.EDITORIAL_WORDS)
    editorial = ~named & (
        (feed & (bylines >= 8) & (words >= 2)) | ((bylines >= 20) & (words >= 3)) | (feed & (words >= 4))
    )
    parts = F.transform(person_name_tokens(maker), F.lower)
    surname = F.slice(parts, F.size(parts), 1)
    given = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    product_terms = F.array_except(c(terms), c("_names"))
    surname_only = (
        F.when(
            is_person_name(maker),
            _present(c("_pool"), surname) & ~_present(c("_pool"), given) & ~_present(c("_pool"), product_terms),
        ).otherwise(False)
    )
    shares_name = F.arrays_overlap(c("identity_tokens"), c("_names"))
    shares_product = F.arrays_overlap(c("identity_tokens"), product_terms)
    other_trade = shares_name & ~shares_product & F.arrays_overlap(c("identity_tokens"), lit_array(vocab.CONFLICTING_BUSINESS_WORDS))
    builder = c("_reg").isin(*vocab.SITE_BUILDERS)
    ladder = [
        (F.coalesce(c("_deny").isin(*vocab.THIRD_PARTY_CLASSES), F.lit(False)), F.concat(F.lit("third_party:"), c("_deny")), 95),
        (c("_reg").isin(*vocab.MAJOR_BRAND_DOMAINS), F.concat(F.lit("major_unrelated_brand:"), c("_reg")), 90),
        (c("_reg").isin(*vocab.PREVIEW_HOSTING), F.lit("hosting_preview_not_official"), 80),
        (institution, F.lit("institutional_not_maker"), 82),
        (media, F.lit("media_or_directory_not_maker"), 80),
        (agency, F.lit("web_agency_not_maker"), 78),
        (editorial, F.lit("editorial_media_not_maker"), 78),
        (surname_only, F.lit("surname_brand_collision"), 75),
        (other_trade, F.lit("same_name_different_business"), 75),
    ]
    collided, reason, conf = None, None, None
    for cond, why, points in ladder:
        hit = F.coalesce(cond, F.lit(False)) & (c("_reg") != "")
        collided = hit if collided is None else collided | hit
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
        conf = F.when(hit, F.lit(points)) if conf is None else conf.when(hit, F.lit(points))
    known = F.size(c("identity_tokens")) > 0
    reason = reason.when(builder, F.lit("site_builder_subdomain")).when(known, F.lit("identity_match")).otherwise(F.lit("insufficient_identity_or_ok"))
    conf = (
        conf.when(builder & known, 35).when(builder, 30).when(known & shares_product, 70).when(known, 60).otherwise(50)
    )
    out = staged.withColumns({"collision": collided, "collision_reason": reason, "collision_confidence": conf})
    return out.drop("_reg", "_deny", "_names", "_pool", "_types", "_tokens")


# --- picking ---------------------------------------------------------------------------------------

def confidence_rank(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def pick_official_site(candidates: DataFrame) -> DataFrame:
    """``candidates(project_id, url, verdict, confidence, source)`` to one site per
    project, or none with the reason."""
    official = F.coalesce(F.col("verdict") == "official", F.lit(False))
    high = F.col("confidence") == "high"
    dom = urls.domain_of(F.col("url"))
    depth = F.length(urls.path(F.col("url")))
    source = F.when(F.col("source") == "page_direct_link", 2).otherwise(1)
    verified_order = F.struct(confidence_rank(F.col("confidence")).alias("c"), source.alias("s"), (-depth).alias("d"), F.col("url"))
    per = candidates.groupBy("project_id").agg(
        F.max_by(F.struct("url", "confidence"), F.when(official, verified_order)).alias("verified"),
        F.countDistinct(F.when(official, dom)).alias("verified_domains"),
        F.min_by("url", F.when(high & (dom != ""), F.struct(depth.alias("d"), F.col("url")))).alias("direct"),
        F.countDistinct(F.when(high & (dom != ""), dom)).alias("direct_domains"),
    )
    clear = (F.col("verified_domains") == 1) | (F.col("verified.confidence") == "high")
    return per.select(
        "project_id",
        F.when(F.col("verified_domains") > 0, F.when(clear, F.col("verified.url")))
        .when(F.col("direct_domains") == 1, F.col("direct"))
        .alias("official_site_url"),
        F.when(F.col("verified_domains") > 0, F.when(clear, "verified").otherwise("several_verified_domains"))
        .when(F.col("direct_domains") == 1, "single_direct_link")
        .when(F.col("direct_domains") > 1, "several_direct_domains")
        .otherwise("only_weak_candidates")
        .alias("reason"),
    )


def official_candidate_score(url: Column, terms: Column) -> Column:
    token = F.substring_index(urls.domain_of(url), ".", 1)
    points = F.aggregate(
        F.filter(terms, lambda t: F.length(t) >= 3),
        F.lit(0),
        lambda acc, t: acc + F.when(t == token, 50).when(F.contains(token, t) | F.contains(t, token), 25).otherwise(0),
    )
    root = F.when(F.trim(urls.path(url), F.lit("/")) == "", 10).otherwise(0)
    return F.when(token == "", 0).otherwise(points + root)


def is_official_candidate(url: Column) -> Column:
    return url.rlike(r"^https?://") & ~urls.is_platform_url(url) & ~contains_any(urls.netloc(url), vocab.AGGREGATOR_HOST_HINTS)


# --- search results ------------------------------------------------------------------------------------

def search_terms(text: Column) -> Column:
    return significant_terms(F.coalesce(text, F.lit("")), vocab.SEARCH_STOP_WORDS)


def search_result_score(
    url: Column, title: Column, snippet: Column, *, project_terms: Column, maker_terms: Column, official_domain: Column
) -> tuple[Column, Column]:
    """Score and reason codes; -1 for results that must be left out."""
    first = F.get(
        F.array_compact(F.array(*[F.when(url.rlike("(?i)" + p), F.lit(n)) for n, p in vocab.SOCIAL_HOSTS.items()])), 0
    )
    inside = lambda terms, where: F.coalesce(F.exists(terms, lambda t: F.contains(where, t)), F.lit(False))

    def judge(v):
        u, platform, address, words = v["url"], v["platform"], v["address"], v["words"]
        p_text, m_text = inside(v["project"], words), inside(v["maker"], words)
        ours = (v["official"] != "") & F.endswith(v["net"], v["official"])
        profile = social_profile(platform, u).isNotNull()
        parts = [
            ("url_title", inside(v["project"], address), 30),
            ("url_maker", inside(v["maker"], address), 25),
            ("text_both", p_text & m_text, 25),
            ("text_one", p_text != m_text, 10),
            ("official_domain", ours, 30),
            ("instagram", (platform == "instagram") & profile, 35),
            ("facebook", (platform == "facebook") & profile, 30),
            ("linkedin", (platform == "linkedin") & profile, 35),
        ]
        hits = F.array_compact(
            F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("code"), F.lit(p).alias("points"))) for n, cond, p in parts])
        )
        own_account = platform.isNotNull() & F.coalesce(is_platform_profile(platform, u), F.lit(False))
        excluded = (
            F.when(contains_any(F.lower(u), vocab.SEARCH_EXCLUDED_PARTS), "excluded_url")
            .when(urls.is_platform_url(u), "excluded_platform")
            .when(own_account, "excluded_own_account")
        )
        return let_all(
            {"hits": hits, "excluded": excluded},
            lambda r: F.struct(
                F.when(r["excluded"].isNotNull(), -1)
                .otherwise(F.aggregate(r["hits"], F.lit(0), lambda n, h: n + h["points"]))
                .alias("score"),
                F.coalesce(r["excluded"], F.array_join(F.transform(r["hits"], lambda h: h["code"]), ",")).alias("reason"),
            ),
        )

    judged = let_all(
        {
            "url": url,
            "net": urls.netloc(url),
            "platform": F.when(~url.rlike("(?i)" + vocab.SOCIAL_SHARE_PATTERN), first),
            "address": F.concat_ws(" ", urls.netloc(url), F.translate(F.lower(urls.path(url)), "/-_", "   ")),
            "words": F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))),
            "project": project_terms,
            "maker": maker_terms,
            "official": F.coalesce(official_domain, F.lit("")),
        },
        judge,
    )
    return judged["score"], judged["reason"]


def maker_core(name: Column) -> Column:
    forms = "|".join(quote_regex(f) for f in vocab.CORPORATE_FORMS)
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), forms, " "), r"\s+", "")


def infer_official(results: DataFrame) -> DataFrame:
    """Official root per project from scored results, by the domain token.

    ``results(project_id, url, score, terms, position)``; the best score wins, the
    earlier result on a tie.
    """
    token = F.substring_index(urls.domain_of(F.col("url")), ".", 1)
    hit = (
        (token != "")
        & ~contains_any(urls.netloc(F.col("url")), vocab.SEARCH_NON_OFFICIAL_HINTS)
        & F.exists("terms", lambda t: F.contains(token, t) | F.contains(t, token))
    )
    order = F.struct(F.col("score"), (-F.col("position")).alias("first"))
    return results.filter(hit).groupBy("project_id").agg(F.max_by(urls.root_url(F.col("url")), order).alias("official_url"))


def title_candidates(results: DataFrame, deny_hints=vocab.TITLE_CANDIDATE_DENY) -> DataFrame:
    """Fallback: result titles naming the maker, one root per domain with its best (score, first)."""
    core = maker_core(F.col("maker_name"))
    bare = F.regexp_replace(F.coalesce(F.col("title"), F.lit("")), r"\s+", "")
    host = urls.netloc(F.col("url"))
    ok = (F.length(core) >= 2) & F.contains(bare, core) & ~contains_any(host, vocab.SEARCH_NON_OFFICIAL_HINTS + tuple(deny_hints))
    order = F.struct(F.col("score"), (-F.col("position")).alias("first"))
    return (
        results.filter(ok & (urls.domain_of(F.col("url")) != ""))
        .groupBy("project_id", "maker_name", urls.domain_of(F.col("url")).alias("domain"))
        .agg(F.max_by(urls.root_url(F.col("url")), order).alias("root"), F.max(order).alias("best"))
    )


def identity_names_maker(names: Column, maker_name: Column) -> Column:
    """The maker appears in a name of the site that is no error page."""
    core = maker_core(maker_name)
    good = F.filter(names, lambda n: ~contains_any(F.lower(n), vocab.IDENTITY_ERROR_WORDS))
    return (F.length(core) >= 2) & F.exists(good, lambda n: F.contains(F.regexp_replace(n, r"\s+", ""), core))


def _names_brand(text: Column, aliases: tuple[str, ...]) -> Column:
    """ASCII aliases count as whole words, others anywhere in the text without its blanks."""
    words = F.regexp_extract_all(text, F.lit("([a-z0-9]+)"))
    bare = F.regexp_replace(text, r"\s+", "")
    return any_of([F.array_contains(words, a) if a.isascii() else F.contains(bare, F.lit(a)) for a in aliases])


def foreign_brand(names: Column, maker_name: Column) -> Column:
    """First large brand that the names of a site show and the maker's name does not; NULL for none."""
    shown, own = F.lower(F.array_join(names, " ")), F.lower(F.coalesce(maker_name, F.lit("")))
    return F.coalesce(*[F.when(_names_brand(shown, group) & ~_names_brand(own, group), F.lit(group[0])) for group in vocab.MAJOR_BRANDS])


def official_by_title(results: DataFrame, identities: DataFrame, deny_hints=vocab.TITLE_CANDIDATE_DENY) -> DataFrame:
    """Official root per project from result titles that name its maker.

    ``identities(domain, names)`` are the names found on the front page of a domain, as ``site_identity`` reads them. A candidate
    is taken if its site names the maker and no large brand beside it; of those the best score wins, then the earlier result.
    Domains without an identity are not taken."""
    found = title_candidates(results, deny_hints).join(identities.select("domain", "names"), "domain")
    ok = identity_names_maker(F.col("names"), F.col("maker_name")) & foreign_brand(F.col("names"), F.col("maker_name")).isNull()
    return found.filter(ok).groupBy("project_id").agg(F.max_by("root", "best").alias("official_url"))


def official_site(results: DataFrame, identities: DataFrame, deny_hints=vocab.TITLE_CANDIDATE_DENY) -> DataFrame:
    """(project_id, official_url, how): by the domain token, and for projects that this leaves open by title and identity."""
    by_domain = infer_official(results).withColumn("how", F.lit("domain"))
    by_title = official_by_title(results, identities, deny_hints).withColumn("how", F.lit("title"))
    return by_domain.unionByName(by_title.join(by_domain.select("project_id"), "project_id", "left_anti"))


# --- crawl order -----------------------------------------------------------------------------------------

def crawl_tier(url: Column) -> Column:
    low = F.lower(url)
    out = None
    for tier, words in enumerate(vocab.CRAWL_TIERS):
        hit = contains_any(low, words)
        out = F.when(hit, F.lit(tier)) if out is None else out.when(hit, F.lit(tier))
    return out.otherwise(len(vocab.CRAWL_TIERS))


def crawl_frontier(frontier: DataFrame, per_domain: int | None = None) -> DataFrame:
    """URLs worth a visit, contact pages first, at most ``per_domain`` per domain."""
    low = F.lower(F.col("url"))
    ok = ~contains_any(low, vocab.CRAWL_SKIP_WORDS) & ~low.rlike(vocab.PAGINATION_PATTERN) & ~contains_any(low, vocab.PAGINATION_PATHS)
    words = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in vocab.CRAWL_LINK_WORDS), F.lit(0))
    rows = frontier.filter(ok).withColumns({"domain": urls.domain_of(F.col("url")), "tier": crawl_tier(F.col("url")), "words": words})
    w = Window.partitionBy("domain").orderBy("tier", F.col("words").desc(), "url")
    return at_most(rows.withColumn("position", F.row_number().over(w)), per_domain)


def sitemap_urls(sitemaps: DataFrame, cap: int | None = None) -> DataFrame:
    """``(domain, xml)`` to the listed URLs of the same domain, useful ones first."""
    loc = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    rows = sitemaps.select("domain", F.posexplode(loc).alias("pos", "url"))
    rows = rows.filter(F.col("url").rlike(r"^https?://") & F.endswith(urls.netloc(F.col("url")), F.col("domain")))
    rows = rows.groupBy("domain", "url").agg(F.min("pos").alias("pos"))
    useful = contains_any(F.lower(F.col("url")), vocab.SITEMAP_WORDS)
    w = Window.partitionBy("domain").orderBy(useful.desc(), "pos", "url")
    return at_most(rows.withColumn("position", F.row_number().over(w)), cap).drop("pos")



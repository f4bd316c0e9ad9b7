"""Search queries, slugs and candidate domains per project, as ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import urls
from leadloom.functions.binding import let_all
from leadloom.functions.text import squash

# Words and sites put next to a name, in the order they are tried.
TITLE_MAKER_WORDS = ("Instagram", "Facebook", "LinkedIn")
TITLE_WORDS = ("Instagram", "Facebook", "LinkedIn", "official Instagram", "official Facebook", "official", "brand")
MAKER_WORDS = ("Instagram", "Facebook", "LinkedIn", "official", "contact")
HANGUL_WORDS = ("공식몰", "공식 홈페이지", "브랜드", "회사", "공식 스토어")
TITLE_SITES = ("instagram.com", "facebook.com", "youtube.com", "tiktok.com")
MAKER_SITES = ("linkedin.com/company", "linkedin.com/in", "instagram.com", "facebook.com")
SHORT_WORDS = ("Instagram", "Facebook", "official website")
SLUG_WORDS = ("contact", "email", "Instagram", "Facebook", "LinkedIn", "YouTube", "official website")
SLUG_SITES = (
    "youtube.com", "instagram.com", "facebook.com", "linkedin.com", "github.com", "linktr.ee", "carrd.co",
    "beacons.ai",
)
TITLE_CONTACT_WORDS = ("contact", "email", "support", "partnership", "distributor")
MAKER_CONTACT_WORDS = ("contact", "email", "partnership", "wholesale", "distributor")
STARTUP_WORDS = ("Product Hunt", "Crunchbase", "GitHub", "YC", "founder", "LinkedIn company")
STARTUP_SITES = (
    "producthunt.com", "github.com", "ycombinator.com", "crunchbase.com", "linkedin.com/company",
    "linkedin.com/in", "apps.apple.com", "play.google.com", "medium.com", "substack.com",
)
DOMAIN_QUERY_TAILS = (
    "contact", "email", "partnership", "wholesale", "distributor", "filetype:pdf", "distributor filetype:pdf",
)
FALLBACK_SLUG_WORDS = ("contact", "email", "Instagram", "YouTube")
FALLBACK_SLUG_SITES = ("instagram.com", "youtube.com", "linktr.ee", "linkedin.com")
FALLBACK_WORDS = ("", " Facebook", " Instagram", " LinkedIn", " official website")
SLUG_STOP = ("projects", "project", "profile", "www", "en", "discover")
GUESS_SUFFIXES = (".com", ".ai", ".io", ".co", ".app", ".net")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _unique(queries: list[Column]) -> Column:
    """Queries in order, blanks squeezed, empty and repeated ones dropped."""
    flat = F.transform(F.array_compact(F.array(*queries)), squash)
    return F.array_distinct(F.filter(flat, lambda q: q != ""))


def _quoted(name: Column, words) -> list[Column]:
    return [F.when(_filled(name), F.concat(F.lit('"'), name, F.lit('" '), F.lit(w))) for w in words]


def _on_sites(name: Column, sites, quoted: bool = True) -> list[Column]:
    q = '"' if quoted else ""
    return [F.when(_filled(name), F.concat(F.lit(f"site:{s} {q}"), name, F.lit(q))) for s in sites]


def contact_queries(maker: Column, official_domain: Column) -> Column:
    """Queries to find a maker by hand; a placeholder domain adds none."""
    name = F.trim(F.coalesce(maker, F.lit("")))
    dom = F.when(_filled(official_domain) & urls.is_business_url(F.concat(F.lit("https://"), official_domain)), official_domain)
    tails = [*vocab.DOMAIN_SEARCH_KEYWORDS, "filetype:pdf", "distributor filetype:pdf"]
    return _unique(
        _quoted(name, vocab.SEARCH_KEYWORDS)
        + _on_sites(name, vocab.SEARCH_SITES)
        + [F.when(dom.isNotNull(), F.concat(F.lit('"'), dom, F.lit('" contact email')))]
        + [F.when(dom.isNotNull(), F.concat(F.lit("site:"), dom, F.lit(f" {t}"))) for t in tails]
    )


def japan_queries(product: Column, maker: Column) -> Column:
    p, m = F.trim(F.coalesce(product, F.lit(""))), F.trim(F.coalesce(maker, F.lit("")))
    shop, business = F.when(p != "", p).otherwise(m), F.when(m != "", m).otherwise(p)
    return _unique(
        [
            shop,
            F.when((p != "") & (m != "") & (p != m), F.concat_ws(" ", p, m)),
            F.when(business != "", F.concat(business, F.lit(" 日本 代理店"))),
            F.when(business != "", F.concat(business, F.lit(" 日本法人"))),
        ]
    )


def channel_search_url(channel: str, product: Column, maker: Column) -> Column:
    """Where a person can check one Japanese sales channel."""
    p, m = F.trim(F.coalesce(product, F.lit(""))), F.trim(F.coalesce(maker, F.lit("")))
    shop, business = F.when(p != "", p).otherwise(m), F.when(m != "", m).otherwise(p)
    path = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    google = lambda c: F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(c))
    after = {"distributor": " 日本 代理店", "subsidiary": " 日本法人", "jp_official_site": " 公式 日本語", "jp_official_shop": " 公式 通販 購入"}
    before = {"makuake": "site:makuake.com ", "greenfunding": "site:greenfunding.jp ", "campfire": "site:camp-fire.jp "}
    if channel == "amazon":
        return F.concat(F.lit("https://www.amazon.co.jp/s?k="), F.url_encode(shop))
    if channel == "rakuten":
        return F.concat(F.lit("https://search.rakuten.co.jp/search/mall/"), path(shop), F.lit("/"))
    if channel == "yahoo":
        return F.concat(F.lit("https://shopping.yahoo.co.jp/search?p="), F.url_encode(shop))
    if channel in after:
        return google(F.concat(business, F.lit(after[channel])))
    return google(F.concat(F.lit(before.get(channel, "")), shop))


# --- slugs --------------------------------------------------------------------------------

def _slug_ok(seg: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(seg, F.lit(""))))
    return ~s.isin("", *SLUG_STOP) & ~s.rlike(r"^\d+$") & s.rlike(r"^[a-z0-9][a-z0-9._\-]+$")


def _slugs_of(url: Column) -> Column:
    """Creator, project and single-segment slug of one URL."""
    parts = F.filter(F.split(urls.path(F.coalesce(url, F.lit(""))), "/"), lambda p: p != "")

    def pick(v):
        parts, low = v["parts"], F.transform(v["parts"], F.lower)
        after = lambda key: F.get(parts, F.array_position(low, key).cast("int"))
        profile = F.when(F.array_contains(low, "profile") & _slug_ok(after("profile")), after("profile"))
        at = F.when(F.array_contains(low, "projects"), F.array_position(low, "projects")).when(
            F.array_contains(low, "project"), F.array_position(low, "project")
        )
        rest = F.slice(parts, at.cast("int") + 1, F.size(parts) + 1)
        two = (F.size(rest) >= 2) & _slug_ok(F.get(rest, 0)) & _slug_ok(F.get(rest, 1))
        one = (F.size(rest) == 1) & _slug_ok(F.get(rest, 0))
        return F.struct(
            F.coalesce(profile, F.when(two, F.get(rest, 0))).alias("creator"),
            F.when(two, F.get(rest, 1)).when(one, F.get(rest, 0)).alias("project"),
            F.when((F.size(parts) == 1) & _slug_ok(F.get(parts, 0)), F.get(parts, 0)).alias("single"),
        )

    return let_all({"parts": parts}, pick)


def slugs(source_url: Column, maker_url: Column) -> Column:
    """``struct<creator, project>`` from campaign and profile URLs, the first one wins."""

    def pick(v):
        a, b = v["a"], v["b"]
        creator1, project1 = a["creator"], a["project"]
        project1 = F.coalesce(project1, F.when(creator1.isNull(), a["single"]))
        creator2, project2 = F.coalesce(creator1, b["creator"]), F.coalesce(project1, b["project"])
        project2 = F.coalesce(project2, F.when(creator2.isNull(), b["single"]))
        return F.struct(F.coalesce(creator2, F.lit("")).alias("creator"), F.coalesce(project2, F.lit("")).alias("project"))

    return let_all({"a": _slugs_of(source_url), "b": _slugs_of(maker_url)}, pick)


def guessed_domains(brand: Column, slug: Column, project_slug: Column, cap: int | None = None) -> Column:
    """Likely site roots from slugs and the brand, in order, at most ``cap``."""
    bare = F.transform(F.array(slug, project_slug, brand), lambda n: F.regexp_replace(F.lower(F.coalesce(n, F.lit(""))), r"[^a-z0-9]", ""))
    names = F.array_distinct(F.filter(bare, lambda n: F.length(n) >= 3))
    hosts = F.flatten(
        F.transform(
            names,
            lambda n: F.array(
                *[F.concat(n, F.lit(s)) for s in GUESS_SUFFIXES],
                F.concat(F.lit("get"), n, F.lit(".com")), F.concat(n, F.lit("app.com")), F.concat(n, F.lit("hq.com")),
            ),
        )
    )
    roots = F.array_distinct(F.transform(hosts, lambda h: F.concat(F.lit("https://"), h)))
    return roots if cap is None else F.slice(roots, 1, cap)


# --- web queries -------------------------------------------------------------------------------

def _slug_block(title: Column, creator: Column, project: Column, when: Column) -> list[Column]:
    out = [
        F.when(when & _filled(title) & _filled(creator), F.concat_ws(" ", title, creator)),
        F.when(when & _filled(title) & _filled(creator), F.concat_ws(" ", creator, title)),
    ]
    for s in (creator, project):
        use = when & _filled(s)
        dashed = use & F.contains(s, F.lit("-"))
        out += [F.when(use, s), F.when(dashed, F.replace(s, F.lit("-"), F.lit(" "))), F.when(dashed, F.replace(s, F.lit("-"), F.lit("")))]
        out += [F.when(use, F.concat(s, F.lit(f" {w}"))) for w in SLUG_WORDS]
        out += [F.when(use, F.concat(F.lit(f"site:{x} "), s)) for x in SLUG_SITES]
    return out


def web_queries(k: dict[str, Column]) -> Column:
    """Queries by priority from title, short, maker, domain, brands (array), source_site,
    creator and project. Short makers are searched by slug first; Hangul makers get
    Korean wording in place of the start-up sources."""
    title, short, maker, domain = k["title"], k["short"], k["maker"], k["domain"]
    creator, project = k["creator"], k["project"]
    vague = _filled(maker) & (F.length(F.replace(maker, F.lit(" "), F.lit(""))) <= 5)
    hangul = F.coalesce(maker.rlike(r"[가-힣]"), F.lit(False))
    both = _filled(title) & _filled(maker)
    head = [F.when(both, F.concat(F.lit('"'), title, F.lit('" "'), maker, F.lit(f'" {w}'))) for w in TITLE_MAKER_WORDS]
    brands = F.flatten(
        F.transform(
            F.coalesce(k["brands"], F.array().cast("array<string>")),
            lambda b: F.array(F.concat(F.lit('"'), b, F.lit('" Instagram')), F.concat(F.lit('"'), b, F.lit('" official'))),
        )
    )
    named = F.slice(F.array_distinct(F.filter(F.array(title, maker, short, creator, project), _filled)), 1, 2)
    startups = F.flatten(
        F.transform(
            F.when(hangul, F.array().cast("array<string>")).otherwise(named),
            lambda b: F.array(
                *[F.concat(F.lit('"'), b, F.lit(f'" {w}')) for w in STARTUP_WORDS],
                *[F.concat(F.lit(f'site:{s} "'), b, F.lit('"')) for s in STARTUP_SITES],
            ),
        )
    )
    first = head + _quoted(title, TITLE_WORDS) + _slug_block(title, creator, project, vague) + _quoted(maker, MAKER_WORDS)
    first += [F.when(hangul, F.concat(F.lit('"'), maker, F.lit(f'" {w}'))) for w in HANGUL_WORDS]
    first += _slug_block(title, creator, project, ~vague)
    first += _on_sites(title, TITLE_SITES) + _on_sites(maker, MAKER_SITES) + _quoted(short, SHORT_WORDS)
    last = _quoted(title, ("official website", "brand official")) + _quoted(maker, ("official website",))
    last += [F.when(_filled(k["source_site"]) & _filled(title), F.concat(F.lit('"'), k["source_site"], F.lit('" "'), title, F.lit('" official')))]
    last += _quoted(title, TITLE_CONTACT_WORDS) + _quoted(maker, MAKER_CONTACT_WORDS)
    tail = [F.when(_filled(domain), F.concat(F.lit("site:"), domain, F.lit(f" {t}"))) for t in DOMAIN_QUERY_TAILS]
    all_ = F.concat(F.array_compact(F.array(*first)), brands, F.array_compact(F.array(*last)), startups, F.array_compact(F.array(*tail)))
    return F.array_distinct(F.filter(F.transform(all_, squash), lambda q: q != ""))


def fallback_queries(title: Column, short: Column, maker: Column, creator: Column, project: Column) -> Column:
    """Short queries for when the full ones find nothing."""
    head = F.when(_filled(short), short).otherwise(title)
    base = F.trim(F.when(_filled(F.trim(maker)), maker).otherwise(F.substring_index(F.trim(head), " ", 1)))
    out = []
    for s in (creator, project):
        out.append(F.when(_filled(s) & _filled(title), F.concat_ws(" ", title, s)))
        out += [F.when(_filled(s), F.concat(s, F.lit(f" {w}"))) for w in FALLBACK_SLUG_WORDS]
        out += [F.when(_filled(s), F.concat(F.lit(f"site:{x} "), s)) for x in FALLBACK_SLUG_SITES]
    out += [F.when(_filled(base), F.trim(F.concat(base, F.lit(w)))) for w in FALLBACK_WORDS]
    return _unique(out)

"""URL, host and domain expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.binding import let, let_all
from leadloom.functions.text import any_of, contains_any


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def hostname(url: Column) -> Column:
    """Host without credentials and port; empty when there is none."""
    bare = F.regexp_replace(netloc(url), r"^[^@]*@", "")
    return F.regexp_replace(bare, r":\d*$", "")


def path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def domain_of(url: Column) -> Column:
    return strip_www(netloc(url))


def host_of(url_host_or_email: Column) -> Column:
    """Lower-case host of a URL, bare host or address, without port and ``www.``."""

    def pick(s):
        return (
            F.when(F.contains(s, F.lit("://")), F.regexp_extract(s, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1))
            .when(F.contains(s, F.lit("@")), F.substring(s, F.locate("@", s) + F.lit(1), F.length(s)))
            .otherwise(s)
        )

    picked = let(F.lower(F.trim(F.coalesce(url_host_or_email, F.lit("")))), pick)
    return strip_www(F.regexp_extract(picked, r"^([^:/]*)", 1))


def registrable_of_host(host: Column) -> Column:
    """eTLD+1 of a bare host with the two-level suffixes the domain knows."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*vocab.TWO_LEVEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def registrable_domain(url_host_or_email: Column) -> Column:
    return let(host_of(url_host_or_email), registrable_of_host)


def domain_token(url_host_or_email: Column) -> Column:
    return F.substring_index(registrable_domain(url_host_or_email), ".", 1)


def under_domain(host: Column, domain) -> Column:
    """Equal to the domain or below it."""
    d = domain if isinstance(domain, Column) else F.lit(domain)
    return (host == d) | F.endswith(host, F.concat(F.lit("."), d))


def _either(names) -> str:
    return "|".join(re.escape(n) for n in names)


def under_any(host: Column, domains) -> Column:
    """One pattern, whatever the number of domains: the host ends in one of them, at a label's start."""
    return host.rlike(rf"(?:^|\.)(?:{_either(domains)})\z")


def first_under(host: Column, domains) -> Column:
    """First domain of the list (in list order) the host is under, else NULL."""
    out = None
    for d in domains:
        hit = under_domain(host, d)
        out = F.when(hit, F.lit(d)) if out is None else out.when(hit, F.lit(d))
    return out


def matches_host_rules(host: Column, rules) -> Column:
    """Rules ending in a dot name a label under any suffix, others a domain."""
    labels = [r[:-1] for r in rules if r.endswith(".")]
    domains = [r for r in rules if not r.endswith(".")]
    tests = []
    if labels:
        tests.append(host.rlike(rf"(?:^|\.)(?:{_either(labels)})(?:\.|\z)"))
    if domains:
        tests.append(under_any(host, domains))
    return any_of(tests)


def first_host_rule(host: Column, rules) -> Column:
    out = None
    for r in rules:
        hit = (
            F.array_contains(F.split(host, r"\."), r[:-1]) if r.endswith(".") else under_domain(host, r)
        )
        out = F.when(hit, F.lit(r)) if out is None else out.when(hit, F.lit(r))
    return out


def business_url_reason(url: Column) -> Column:
    """Why a URL cannot be used for business, NULL when it can."""

    def judge(v):
        raw, sch, host, p = v["raw"], v["scheme"], v["host"], v["path"]
        bad_label = F.get(F.filter(F.split(host, r"\."), lambda x: x.isin(*vocab.PLACEHOLDER_HOST_LABELS)), 0)
        out = (
            F.when(raw == "", F.lit("empty"))
            .when(~sch.isin("http", "https"), F.concat(F.lit("scheme:"), F.when(sch == "", "none").otherwise(sch)))
            .when(host == "", F.lit("no_host"))
            .when(host.isin(*vocab.LOCAL_HOSTS), F.concat(F.lit("dummy_host:"), host))
            .when(bad_label.isNotNull(), F.concat(F.lit("dummy_host:"), bad_label))
            .when(F.contains(host, F.lit("githubusercontent")), F.lit("blocked_host:githubusercontent"))
        )
        for token in vocab.PLACEHOLDER_PATHS:
            out = out.when(F.contains(p, F.lit(token)), F.lit(f"placeholder_path:{token}"))
        return out

    raw = F.trim(F.coalesce(url, F.lit("")))
    return let_all({"raw": raw, "scheme": scheme(raw), "host": hostname(raw), "path": F.lower(path(raw))}, judge)


def is_business_url(url: Column) -> Column:
    return business_url_reason(url).isNull()


def campaign_url_reason(url: Column, site: Column) -> Column:
    """Why a project's URL is not its campaign page, NULL when it is."""

    def judge(v):
        fits = any_of([(v["site"] == s) & under_domain(v["host"], d) for s, d in vocab.CAMPAIGN_DOMAINS.items()])
        return (
            F.when(v["site"].isNull() | ~v["site"].isin(*vocab.CAMPAIGN_DOMAINS), F.lit("unsupported_site"))
            .when(v["url"].isNull() | (F.trim(v["url"]) == ""), F.lit("no_source_url"))
            .when(v["bad"].isNotNull(), F.lit("invalid_url"))
            .when(~fits, F.lit("not_campaign_domain"))
        )

    return let_all(
        {"url": url, "site": site, "host": hostname(F.trim(url)), "bad": business_url_reason(url)}, judge
    )


def campaign_url(url: Column, site: Column) -> Column:
    return F.when(campaign_url_reason(url, site).isNull(), F.trim(url))


def is_platform_url(url: Column) -> Column:
    return under_any(domain_of(url), vocab.NON_OFFICIAL_PLATFORMS)


def official_site_or_none(url: Column) -> Column:
    """The URL when it may stand as a maker's own site, else NULL."""
    ok = let(
        F.substring_index(netloc(url), ":", 1),
        lambda host: ~under_any(strip_www(host), vocab.NON_OFFICIAL_PLATFORMS)
        & ~matches_host_rules(host, vocab.NON_OFFICIAL_HOSTS)
        & ~matches_host_rules(host, vocab.REJECTED_OFFICIAL_HOSTS),
    )
    return F.when(url.rlike(r"^https?://") & ok & is_business_url(url), url)


def maker_site(url: Column) -> Column:
    """Maker URL of a project when it is a usable site outside the platforms."""
    host = hostname(url)
    platform = under_any(host, vocab.CROWDFUNDING_PLATFORMS + vocab.CROWDFUNDING_MARKETING)
    return F.when(is_business_url(url) & ~platform, F.trim(url))


def root_url(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


# --- page kinds ---------------------------------------------------------------

def form_intent(url: Column) -> Column:
    p = F.lower(path(url))
    out = None
    for name, hints in vocab.FORM_INTENTS:
        hit = contains_any(p, hints)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise("other")


def is_utility_form(url: Column) -> Column:
    return contains_any(F.lower(path(url)), vocab.UTILITY_FORM_PATHS)


def form_path_rank(url: Column) -> Column:
    p = F.rtrim(F.lower(path(url)), F.lit("/"))
    position = F.array_position(lit_array(vocab.FORM_PATH_ORDER), p)
    return F.when(position == 0, len(vocab.FORM_PATH_ORDER)).otherwise(position - 1).cast("int")


def is_platform_account(url: Column) -> Column:
    """A social link that is the platform's own account."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return under_any(host_of(u), vocab.SOCIAL_ACCOUNT_HOSTS) & path(u).rlike(
        "(?i)" + vocab.PLATFORM_HANDLE_PATTERN
    )

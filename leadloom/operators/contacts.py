"""People, channels and the per-project summary of everything found on its pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom import vocab
from leadloom.functions import urls
from leadloom.functions.pandas_udfs import unescape_entities
from leadloom.functions.binding import let, let_all
from leadloom.functions.text import any_of, contains_any, map_lookup, significant_terms, unique_ignoring_case
from leadloom.operators import emails as em
from leadloom.operators import sites
from leadloom.operators.emails import deny_class

STRINGS = "array<string>"

# --- people ----------------------------------------------------------------------------


def title_priority(title: Column) -> tuple[Column, Column]:
    """Department and priority of a job title, first rule wins."""
    low = F.lower(title)
    dept, prio = None, None
    for words, name, points in vocab.TITLE_RULES:
        hit = contains_any(low, words)
        dept = F.when(hit, F.lit(name)) if dept is None else dept.when(hit, F.lit(name))
        prio = F.when(hit, F.lit(points)) if prio is None else prio.when(hit, F.lit(points))
    none = F.trim(F.coalesce(title, F.lit(""))) == ""
    return F.when(~none, dept.otherwise("Other")), F.when(none, 40).otherwise(prio.otherwise(50))


def looks_like_name(text: Column) -> Column:
    """Two to four capitalised words, none of them interface or job wording."""
    name = F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(" .,-"))
    words = F.transform(F.split(name, " "), lambda w: F.trim(F.lower(w), F.lit(".,'-")))
    banned = urls.lit_array(vocab.NON_NAME_WORDS + vocab.TITLE_WORDS)
    ok = name.rlike(vocab.PERSON_NAME_PATTERN) & (F.length(name) <= 60) & ~name.rlike(r"\d")
    return F.coalesce(ok & ~F.arrays_overlap(words, banned), F.lit(False))


def person_confidence(has_name: Column, has_linkedin: Column, has_email: Column, known_title: Column) -> Column:
    points = (
        F.when(has_name, 35).otherwise(10)
        + F.when(has_linkedin, 35).otherwise(0)
        + F.when(has_email, 20).otherwise(0)
        + F.when(known_title, 15).otherwise(0)
    )
    return F.least(F.lit(100), points)


def owned_person_source(url: Column, official_domain: Column) -> Column:
    """A page a person may be taken from: no third party, and on the official domain
    when that is known."""
    third = deny_class(url).isin(*vocab.THIRD_PARTY_CLASSES)
    official = F.coalesce(official_domain, F.lit(""))
    same = urls.registrable_domain(url) == urls.registrable_domain(official)
    return (F.coalesce(url, F.lit("")) != "") & ~F.coalesce(third, F.lit(False)) & ((official == "") | same)


def _title_at_start(text: Column) -> Column:
    """The job title that a text begins with; some titles go on with the field they are for."""
    low = F.lower(text)
    field = F.regexp_extract(text, "^[A-Za-z ]+", 0)
    found = [F.when(F.startswith(low, F.lit(t.lower())), F.substring(text, 1, len(t))) for t in vocab.PERSON_TITLES]
    found += [F.when(F.startswith(low, F.lit(t.lower() + " ")) & (F.length(F.trim(field)) > len(t)), field) for t in vocab.PERSON_TITLES_WITH_FIELD]
    return F.coalesce(*found)


def _name_at_end(text: Column) -> Column:
    """Given and family name that a text ends with, an initial between them or not, read word by word from the end."""

    def read(words):
        n = F.size(words)
        last, before = F.get(words, n - 1), F.get(words, n - 2)
        initial = before.rlike(r"^[A-Za-z]\.$")
        given = F.regexp_extract(F.when(initial, F.get(words, n - 3)).otherwise(before), "([A-Za-z]{2,})$", 1)
        whole = F.when(initial, F.concat_ws(" ", given, before, last)).otherwise(F.concat_ws(" ", given, last))
        return F.when(last.rlike("^[A-Za-z]{2,}$") & (given != ""), whole)

    return let(F.split(F.rtrim(text), r"\s"), read)


def titled_people(text: Column) -> Column:
    """array<struct<position, name, title>>: a name, one separator, a title. The text is cut at the separators, but for the one in "co-founder"."""
    others = "".join(c for c in vocab.PERSON_SEPARATORS if c != "-")
    pieces = F.split(text, rf"[{others}]|(?<!(?i:co))-")
    pairs = F.zip_with(pieces, F.slice(pieces, 2, F.size(pieces)), lambda a, b: F.struct(a.alias("a"), F.ltrim(b).alias("b")))
    found = F.transform(pairs, lambda p, i: F.struct(i.alias("position"), _name_at_end(p["a"]).alias("name"), F.trim(_title_at_start(p["b"])).alias("title")))
    return F.filter(found, lambda p: p["name"].isNotNull() & p["title"].isNotNull())


def people_on_pages(texts: DataFrame) -> DataFrame:
    """``(project_id, url, text, official_domain)`` to people with title, department and
    priority: every name of a page, where it stands first."""
    rows = texts.select("project_id", "url", "official_domain", F.explode(titled_people(F.col("text"))).alias("hit"))
    rows = rows.select("project_id", "url", "official_domain", "hit.*")
    rows = rows.filter(looks_like_name(F.col("name")) & owned_person_source(F.col("url"), F.col("official_domain")))
    first = F.min(F.struct("position", "name", "title")).alias("first")
    rows = rows.groupBy("project_id", "url", "official_domain", F.lower("name").alias("_key")).agg(first)
    rows = rows.select("project_id", "url", "official_domain", "first.*")
    dept, prio = title_priority(F.col("title"))
    known = dept.isNotNull() & (dept != "Other")
    return rows.withColumns(
        {
            "department": dept,
            "priority": prio,
            "confidence": person_confidence(F.lit(True), F.lit(False), F.lit(False), known),
        }
    )


# --- channels ---------------------------------------------------------------------------

def _has(socials: Column, key: str) -> Column:
    return F.coalesce(F.element_at(socials, key) != "", F.lit(False))


def _tier_flags(tiers: Column) -> dict[str, Column]:
    tiers = F.coalesce(tiers, F.array().cast(STRINGS))
    return {
        "high": F.array_contains(tiers, "high"),
        "mid": F.array_contains(tiers, "mid") | F.array_contains(tiers, "other"),
        "low": F.array_contains(tiers, "low"),
    }


def contactability(tiers: Column, has_form: Column, socials: Column, has_official: Column) -> Column:
    """Best channel plus 5 for every further one, at most 100."""
    flags = _tier_flags(tiers)
    values = [F.when(flags[t], v) for t, v in vocab.EMAIL_TIER_VALUES]
    values.append(F.when(has_form, vocab.FORM_VALUE))
    values += [F.when(_has(socials, k), v) for k, v in vocab.SOCIAL_VALUES.items()]
    found = F.array_compact(F.array(*values))
    best = F.least(F.lit(100), F.array_max(found) + (F.size(found) - 1) * 5)
    return F.when(F.size(found) == 0, F.when(has_official, 25).otherwise(5)).otherwise(best)


def recommended_channel(tiers: Column, has_form: Column, socials: Column, press_page: Column, wholesale_page: Column) -> Column:
    return (
        F.when(any_of(_tier_flags(tiers).values()), "email")
        .when(has_form, "contact_form")
        .when(_has(socials, "linkedin"), "linkedin")
        .when(_has(socials, "instagram"), "instagram")
        .when(_has(socials, "facebook"), "facebook")
        .when(press_page.isNotNull(), "press")
        .when(wholesale_page.isNotNull(), "distributor_page")
        .otherwise("manual_research")
    )


def approach_options(email_rows: Column, form: Column, socials: Column, press_page: Column, wholesale_page: Column, documents: Column) -> Column:
    """Ways to reach the maker, best score first."""
    option = lambda channel, url, score: F.struct(F.lit(channel).alias("channel"), url.cast("string").alias("url"), score.cast("int").alias("score"))
    fixed = [
        ("contact_form", form), ("linkedin", F.element_at(socials, "linkedin")), ("instagram", F.element_at(socials, "instagram")),
        ("facebook", F.element_at(socials, "facebook")), ("press", press_page), ("distributor_page", wholesale_page),
    ]
    others = F.array_compact(F.array(*[F.when(F.coalesce(u, F.lit("")) != "", option(k, u, F.lit(vocab.APPROACH_SCORES[k]))) for k, u in fixed]))
    mails = F.transform(email_rows, lambda e: option("email", F.concat(F.lit("mailto:"), e["email"]), e["score"]))
    pdfs = F.transform(documents, lambda d: option("pdf", d["link"], F.when(d["relevant"], 35).otherwise(20)))
    return F.array_sort(F.concat(mails, others, pdfs), lambda a, b: (b["score"] - a["score"]).cast("int"))


def checklist(official_checked: Column, has_form: Column, n_emails: Column, socials: Column, press_page: Column, wholesale_page: Column) -> Column:
    return F.struct(
        official_checked.alias("official_site_checked"), has_form.alias("contact_page_found"), (n_emails > 0).alias("email_found"),
        has_form.alias("contact_form_found"), _has(socials, "instagram").alias("instagram_found"), _has(socials, "facebook").alias("facebook_found"),
        _has(socials, "linkedin").alias("linkedin_found"), press_page.isNotNull().alias("press_page_found"), wholesale_page.isNotNull().alias("wholesale_page_found"),
    )


def channel_ranking(emails: DataFrame, channels: DataFrame, queries: DataFrame) -> DataFrame:
    """Channels of a project by priority, then score.

    ``emails(project_id, email, source_kind)``, ``channels(project_id, channel, target)``
    and ``queries(project_id, query)``; a manual search is listed only when nothing else is.
    """
    kind = F.lower(F.coalesce(F.col("source_kind"), F.lit("")))
    base = (
        F.when(F.contains(kind, F.lit("contact")), 100)
        .when(contains_any(kind, ("about", "footer")), 88)
        .when(contains_any(kind, ("legal", "privacy", "terms")), 55)
        .otherwise(70)
    )
    stars, _ = em.sales_rank(F.col("email"))
    mail_rows = emails.select(
        "project_id", F.lit("email").alias("channel"), F.col("email").alias("target"),
        F.least(F.lit(100), F.greatest(F.lit(20), base + (stars - 3) * 4)).alias("score"),
    )
    known = channels.filter((F.coalesce(F.col("target"), F.lit("")) != "") & F.col("channel").isin(*vocab.CHANNEL_SCORES))
    other_rows = known.select("project_id", "channel", "target", map_lookup(F.col("channel"), vocab.CHANNEL_SCORES).alias("score"))
    found = mail_rows.unionByName(other_rows)
    manual = (
        queries.groupBy("project_id").agg(F.min_by("query", "position").alias("target"))
        .join(found.select("project_id").distinct(), "project_id", "left_anti")
        .select("project_id", F.lit("manual_search").alias("channel"), "target", F.lit(vocab.CHANNEL_SCORES["manual_search"]).alias("score"))
    )
    rows = found.unionByName(manual).withColumn("priority", map_lookup(F.col("channel"), vocab.CHANNEL_PRIORITY))
    w = Window.partitionBy("project_id").orderBy("priority", F.col("score").desc(), "channel", "target")
    return rows.withColumn("position", F.row_number().over(w))


def evidence_score(n_emails: Column, n_forms: Column, socials: Column, has_official: Column, n_people: Column) -> Column:
    main = any_of([_has(socials, k) for k in ("instagram", "facebook", "linkedin")])
    points = [(n_emails > 0, 40), (n_forms > 0, 25), (main, 15), (has_official, 10), (n_people > 0, 15)]
    return F.least(F.lit(100), sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0)))


def mail_host_class(exchanges: Column) -> Column:
    hosts = F.lower(F.array_join(exchanges, " "))
    return (
        F.when(contains_any(hosts, ("google", "aspmx")), "Google Workspace")
        .when(contains_any(hosts, ("outlook", "microsoft")), "Microsoft 365")
        .when(F.contains(hosts, F.lit("zoho")), "Zoho")
        .when(F.size(exchanges) == 0, "")
        .otherwise("Other")
    )


# --- corroborated domains -------------------------------------------------------------------

def role_address(email: Column) -> Column:
    return em.email_role(email).isin("high", "mid", "support")


def corroborated_domains(found: DataFrame, roots: DataFrame, dns: DataFrame) -> DataFrame:
    """Domains with at least two role addresses: ``site`` when their own accepted pages
    publish them, ``siteless`` when the domain only handles mail.

    ``found(project_id, email, sources, terms)``, ``roots(project_id, domain, accepted)``
    and ``dns(domain, has_a, has_mx)`` are inputs.
    """
    reg = urls.registrable_domain(F.col("email"))
    own = F.exists(F.coalesce("sources", F.array().cast(STRINGS)), lambda s: urls.registrable_domain(s) == reg)
    per = (
        found.withColumn("domain", reg)
        .filter((F.col("domain") != "") & role_address(F.col("email")))
        .groupBy("project_id", "domain")
        .agg(F.count(F.lit(1)).alias("n_any"), F.count_if(own).alias("n_self"), F.max("terms").alias("terms"))
    )
    token = F.substring_index("domain", ".", 1)
    named = (F.size("terms") == 0) | F.exists("terms", lambda t: F.contains(token, t) | F.contains(t, token))
    kept = per.filter((F.col("n_any") >= 2) & ~F.col("domain").isin(*vocab.PERSONAL_EMAIL_DOMAINS) & named)
    mode = F.when(F.coalesce("accepted", F.lit(False)) & (F.col("n_self") >= 2), "site").when(
        F.coalesce(~F.col("has_a") & F.col("has_mx"), F.lit(False)), "siteless"
    )
    return (
        kept.join(roots, ["project_id", "domain"], "left")
        .join(dns, "domain", "left")
        .withColumn("mode", mode)
        .filter(F.col("mode").isNotNull())
        .select("project_id", "domain", "mode")
    )


def ownership_split(found: DataFrame, corroborated: DataFrame) -> DataFrame:
    """Adds ``owned`` and ``owned_reason`` to ``found(project_id, email, sources, official_domain)``."""
    rows = found.withColumn("domain", urls.registrable_domain(F.col("email"))).join(
        corroborated.select("project_id", "domain", "mode"), ["project_id", "domain"], "left"
    )
    official = F.coalesce(F.col("official_domain"), F.lit(""))
    off = urls.registrable_domain(official)
    sources = F.coalesce("sources", F.array().cast(STRINGS))
    self_sourced = F.exists(sources, lambda s: urls.registrable_domain(s) == F.col("domain"))
    on_official = F.exists(sources, lambda s: urls.registrable_domain(s) == off)
    rescued = F.col("mode").isNotNull() & role_address(F.col("email")) & ((F.col("mode") == "siteless") | self_sourced)
    personal = F.col("domain").isin(*vocab.PERSONAL_EMAIL_DOMAINS)
    denied = F.coalesce(deny_class(F.col("email")), F.when(F.col("domain").isin(*vocab.MAJOR_BRAND_DOMAINS), "unrelated_company").otherwise("unknown"))
    reason = (
        F.when(official == "", F.when(rescued, F.lit("corroborated_domain")).otherwise("no_verified_official"))
        .when(F.col("domain") == off, F.lit("official_domain"))
        .when(personal & on_official, F.lit("personal_on_official_page"))
        .when(personal, F.lit("personal_off_official_page"))
        .otherwise(F.concat(F.lit("third_party:"), denied))
    )
    owned = F.col("owned_reason").isin("corroborated_domain", "official_domain", "personal_on_official_page")
    return rows.withColumn("owned_reason", reason).withColumn("owned", owned).drop("domain", "mode")


def owned_form(form_url: Column, official_domain: Column) -> Column:
    official = F.coalesce(official_domain, F.lit(""))
    return (official != "") & (urls.registrable_domain(form_url) == urls.registrable_domain(official))


# --- captures -----------------------------------------------------------------------------------

def _after_labels(text: Column, words) -> Column:
    """What stands behind each ``label:`` of the text, up to the end."""
    longest_first = sorted(words, key=len, reverse=True)
    label = "(?:" + "|".join(w.replace(" ", r"\s+") for w in longest_first) + r")\s*[:：]\s*"
    parts = F.split(text, label, -1)
    return F.slice(parts, 2, F.size(parts))


def _first_value(rests: Column, separator: str, least: int) -> Column:
    """The first value of at least ``least`` characters, up to a separator and without the word of a next label."""
    stops = "|".join(vocab.CAPTURE_STOPS)

    def cut(raw):
        # the first character belongs to the value even when a stop word starts there
        kept = F.concat(F.substring(raw, 1, 1), F.element_at(F.split(F.substring(raw, F.lit(2), F.length(raw)), stops), 1))
        return F.struct(F.length(raw).alias("n"), F.trim(F.trim(kept), F.lit(".,;:·・")).alias("value"))

    # bound, as each mention would split the rest of the document again
    values = F.transform(F.transform(rests, lambda rest: F.trim(F.element_at(F.split(rest, separator, 2), 1))), cut)
    return let(F.get(F.filter(values, lambda v: v["n"] >= least), F.lit(0))["value"], lambda first: F.when(F.length(first) >= 2, first))


def labelled_fields(text: Column) -> dict[str, Column]:
    """``label: value`` fields. The text is split at a field's labels; a value of any length runs up to a separator, the end of its
    line or the word of a next label, and the first one that is long enough counts. Slashes and dots may stand in an address."""
    out = {}
    for name, (words, least) in vocab.CAPTURE_LABELS.items():
        out[name] = _first_value(_after_labels(text, words), r"\s{2,}|[<|\n]" if name == "address" else r"\s{2,}|[<|/·・\n]", least)
    phones = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(vocab.CAPTURE_PHONE), F.lit(1))))
    out["phone"] = F.get(phones, 0)
    out["phones"] = phones
    return out


def found_method(text: Column, email: Column) -> Column:
    return let_all(
        {"low": F.lower(text), "addr": F.lower(email)},
        lambda v: F.when(F.contains(v["low"], F.concat(F.lit("mailto:"), v["addr"])), "mailto")
        .when(F.contains(v["low"], v["addr"]), "plain_text")
        .otherwise("deobfuscated"),
    )


def around_hit(text: Column, email: Column, around: int, body) -> Column:
    """``body(window)`` of the text around the first hit, NULL without one."""

    def cut(at):
        start = F.greatest(at - around, F.lit(1))
        return F.when(at > 0, F.substring(text, start, at + F.length(email) + around - start))

    return let(F.position(F.lower(email), F.lower(text)), lambda at: let(cut(at), body))


def snippet(text: Column, email: Column, around: int = 40, cap: int = 120) -> Column:
    return around_hit(text, email, around, lambda w: F.substring(F.trim(F.regexp_replace(w, r"\s+", " ")), 1, cap))


def contact_context(text: Column, email: Column, around: int = 60) -> Column:
    """First contact word near the address."""
    return around_hit(
        text, email, around, lambda w: F.get(F.filter(urls.lit_array(vocab.CAPTURE_CONTEXT), lambda word: F.contains(w, word)), 0)
    )


CHROME = r"(?is)<(footer|nav|header)[^>]*>.*?</\1>"


def capture_records(captures: DataFrame) -> DataFrame:
    """``(capture_id, project_id, url, content)`` to one row per address with region,
    context, method, snippet and confidence, or with the reason it was left out."""
    site = F.lit("wadiz.kr")
    rows = captures.withColumn("plain", unescape_entities(F.col("content")))
    both = F.concat(em.candidates(F.col("content")), em.candidates(F.col("plain")))
    chrome = F.lower(F.array_join(F.regexp_extract_all("content", F.lit(CHROME), F.lit(0)), "\n"))
    rows = rows.withColumns({"found": let(both, unique_ignoring_case), "chrome": unescape_entities(chrome)})
    rows = rows.select("*", F.posexplode_outer("found").alias("position", "email")).filter(F.col("email").isNotNull())
    rows = rows.withColumn("reason", em.exclusion_reason(F.col("email"), site))
    text, addr = F.col("content"), F.col("email")
    in_chrome = F.contains(F.col("chrome"), F.lower(addr))
    tier, _ = em.tier_and_score(addr, F.lit(None).cast("string"))
    base = F.when(tier == "high", "high").when(tier == "low", "low").otherwise("medium")
    context = contact_context(text, addr)
    confidence = F.when(in_chrome, "low").when(context.isNotNull(), F.when(base == "low", "medium").otherwise("high")).otherwise(base)
    return rows.withColumns(
        {
            "region": F.when(in_chrome, "chrome").otherwise("body"),
            "context": context,
            "method": found_method(text, addr),
            "snippet": snippet(text, addr),
            "confidence": F.when(F.col("reason").isNull(), confidence),
        }
    ).select("capture_id", "project_id", "url", "position", "email", "reason", "region", "context", "method", "snippet", "confidence")


# --- project summary -----------------------------------------------------------------------------

def matches_path(url: Column, hints) -> Column:
    return contains_any(F.lower(urls.path(url)), hints)


def contact_summary(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """Everything the pages of a project say about reaching its maker.

    ``pages(project_id, position, url, html)``, ``projects(id, maker_name, title,
    source_site, maker_url)``. Each part is one aggregate keyed by project; the parts
    meet in one chain of joins on that key.
    """
    context = projects.select(
        F.col("id").alias("project_id"),
        "maker_name",
        "title",
        urls.official_site_or_none(F.col("maker_url")).alias("official"),
        em.site_email_domain(F.col("source_site")).alias("site_domain"),
        significant_terms(F.concat_ws(" ", "title", "maker_name")).alias("terms"),
    ).withColumn("official_domain", F.coalesce(urls.domain_of(F.col("official")), F.lit("")))
    based = pages.join(context.select("project_id", "site_domain", "official_domain"), "project_id")

    found = em.page_emails(based.withColumnRenamed("position", "page_position"))
    found = found.filter(em.exclusion_reason(F.col("email"), F.col("site_domain")).isNull())
    tier, score = em.tier_and_score(F.col("email"), F.col("official_domain"))
    found = found.withColumns({"tier": tier, "score": score, "email_key": F.lower("email")})
    order = F.struct(F.col("page_position").alias("p"), F.col("position").alias("q"))
    per_email = found.groupBy("project_id", "email_key").agg(
        F.min_by("email", order).alias("email"),
        F.max_by(F.struct("score", "tier"), F.struct(F.col("score"), (-F.col("page_position")).alias("p"))).alias("best"),
        F.array_sort(F.collect_set("url")).alias("sources"),
        F.min(order).alias("first_seen"),
    )
    top = F.struct(F.col("best.score").alias("s"), (-F.col("first_seen.p")).alias("p"), (-F.col("first_seen.q")).alias("q"))
    emails = per_email.groupBy("project_id").agg(
        F.max_by("email", top).alias("primary_email"),
        F.max("best.score").alias("top_email_score"),
        F.count(F.lit(1)).alias("n_emails"),
        F.collect_set("best.tier").alias("tiers"),
    )

    links = sites.page_links(based.withColumnRenamed("position", "page_position"))
    socials = sites.first_socials(links, ["project_id"], F.struct("page_position", "position"))
    socials = socials.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "social_url")))).alias("socials"))
    documents = (
        sites.document_links(links)
        .groupBy("project_id", "link")
        .agg(F.first("relevant").alias("relevant"), F.min(F.struct("page_position", "position")).alias("seen"))
        .groupBy("project_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "link", "relevant"))), lambda d: F.struct(d["link"].alias("link"), d["relevant"].alias("relevant"))).alias("documents"))
    )

    own = F.coalesce((F.col("official_domain") != "") & F.endswith(urls.netloc(F.col("url")), F.col("official_domain")), F.lit(False))
    form_rows = based.filter(own & matches_path(F.col("url"), vocab.CONTACT_PATH_HINTS)).select("project_id", F.col("url").alias("form_url"), "official_domain")
    forms = sites.maker_forms(form_rows).groupBy("project_id").agg(
        F.min_by("form_url", "position").alias("primary_form"), F.count(F.lit(1)).alias("n_forms")
    )
    kinds = based.groupBy("project_id").agg(
        F.min_by("url", F.when(matches_path(F.col("url"), vocab.PRESS_PATH_HINTS), F.col("position"))).alias("press_page"),
        F.min_by("url", F.when(matches_path(F.col("url"), vocab.WHOLESALE_PATH_HINTS), F.col("position"))).alias("wholesale_page"),
    )

    root_pages = based.filter(own & urls.path(F.col("url")).isin("", "/")).groupBy("project_id").agg(F.min_by(F.struct("url", "html"), "position").alias("root"))
    checked = sites.collision_check(
        sites.site_identity(
            context.filter(F.col("official").isNotNull()).join(root_pages, "project_id", "left")
            .select("project_id", "maker_name", "terms", F.col("official").alias("url"), "root.html")
        )
    ).select("project_id", "collision", "collision_reason")

    parts = [context.drop("title", "terms"), emails, socials, documents, forms, kinds, checked]
    rows = reduce(lambda a, b: a.join(b, "project_id", "left"), parts)
    rows = rows.withColumn("official_site", F.when(~F.coalesce("collision", F.lit(False)), F.col("official"))).fillna(0, ["n_emails", "n_forms"])
    empty = F.map_from_arrays(F.array().cast(STRINGS), F.array().cast(STRINGS))
    rows = rows.withColumn("socials", F.coalesce("socials", empty))
    has_form, has_site = F.col("n_forms") > 0, F.col("official_site").isNotNull()
    confidence = (
        F.when(F.col("n_emails") > 0, F.col("top_email_score")).when(has_form, 40).when(F.size(F.map_keys("socials")) > 0, 20).otherwise(0)
    )
    return rows.withColumns(
        {
            "confidence": confidence,
            "contactability_score": contactability(F.col("tiers"), has_form, F.col("socials"), has_site),
            "recommended_channel": recommended_channel(F.col("tiers"), has_form, F.col("socials"), F.col("press_page"), F.col("wholesale_page")),
        }
    ).drop("tiers", "collision", "official", "site_domain", "top_email_score")

"""Quality metrics against labelled cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import urls
from leadloom.functions.numbers import ratio_percent
from leadloom.functions.text import any_of, contains_any
from leadloom.operators.aggregates import count_where
from leadloom.operators.emails import deny_class
from leadloom.operators.sets import confusion

STRICT = ("verified",)
STRINGS = "array<string>"


def _set(values: Column) -> Column:
    """Trimmed, lower-cased, unique, without blanks; NULL reads as empty."""
    folded = F.transform(F.coalesce(values, F.array().cast(STRINGS)), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(folded, lambda v: v != ""))


def joined(labels: DataFrame, predictions: DataFrame, statuses=STRICT) -> DataFrame:
    """Labels and predictions of the same project, with masks: ``labelled``, ``predicted``, and ``counted`` for labels that
    belong in a denominator. Blocked and unresolved labels leave it; a label without a prediction stays in it, with nulls."""
    one, other = labels.withColumn("labelled", F.lit(True)), predictions.withColumn("predicted", F.lit(True))
    rows = one.join(other, "project_id", "full_outer")
    masks = {name: F.coalesce(F.col(name), F.lit(False)) for name in ("labelled", "predicted")}
    return rows.withColumns({**masks, "counted": F.coalesce(F.col("verification_status").isin(*statuses), F.lit(False))})


def scored(labels: DataFrame, predictions: DataFrame, statuses=STRICT) -> DataFrame:
    """The rows that a score is taken over."""
    return joined(labels, predictions, statuses).filter("counted").drop("labelled", "predicted", "counted")


def coverage(labels: DataFrame, predictions: DataFrame, statuses=STRICT) -> DataFrame:
    """Labels, those counted, and those with a prediction, by status; the null status holds predictions without a label."""
    count = lambda c: F.count_if(c)
    return joined(labels, predictions, statuses).groupBy("verification_status").agg(
        count(F.col("labelled")).alias("n_labels"), count(F.col("counted")).alias("n_counted"),
        count(F.col("labelled") & F.col("predicted")).alias("n_with_prediction"), count(~F.col("labelled")).alias("n_unlabelled"),
    )


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; NULL where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def _totals(rows: DataFrame, by: str | None) -> DataFrame:
    keys = [by] if by else []
    return prf(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn")
        )
    )


def set_scores(cases: DataFrame, expected: Column, predicted: Column, plausible: Column | None = None, by: str | None = None, skip_empty: bool = False) -> DataFrame:
    """Totals of a set comparison per case, optionally per group."""
    rows = cases.withColumns({"_e": _set(expected), "_p": _set(predicted)})
    if skip_empty:
        rows = rows.filter((F.size("_e") > 0) | (F.size("_p") > 0))
    parts = confusion(F.col("_e"), F.col("_p"), _set(plausible) if plausible is not None else None)
    return _totals(rows.withColumns({k: F.size(v) for k, v in parts.items()}), by)


def email_scores(cases: DataFrame, by: str | None = None) -> DataFrame:
    return set_scores(cases, F.col("expected_direct_emails"), F.col("emails"), F.col("plausible_unconfirmed_emails"), by)


def official_scores(cases: DataFrame) -> DataFrame:
    """By registrable domain: extra domains are false positives, a miss counts once more
    as a false negative."""
    rows = cases.filter(F.coalesce("expected_official_site", F.lit("")) != "")
    expected = urls.registrable_domain(F.col("expected_official_site"))
    predicted = F.array_distinct(F.transform(F.coalesce("sites", F.array().cast(STRINGS)), urls.registrable_domain))
    rows = rows.withColumns({"_e": expected, "_p": predicted})
    hit = F.array_contains("_p", F.col("_e"))
    return _totals(
        rows.withColumns(
            {"tp": F.when(hit, 1).otherwise(0), "fp": F.size("_p") - F.when(hit, 1).otherwise(0), "fn": F.when(hit, 0).otherwise(1)}
        ),
        None,
    )


def form_channels(forms: Column) -> Column:
    return F.transform(
        F.coalesce(forms, F.array().cast(STRINGS)), lambda u: F.concat(urls.registrable_domain(u), F.lit("|"), urls.form_intent(u))
    )


def form_scores(cases: DataFrame) -> DataFrame:
    return set_scores(cases, form_channels(F.col("expected_forms")), form_channels(F.col("forms")), skip_empty=True)


def normal_url(url: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    full = F.concat(F.replace(urls.netloc(u), F.lit("www."), F.lit("")), F.rtrim(urls.path(u), F.lit("/")))
    return F.when(F.contains(u, F.lit("://")), full).otherwise(F.rtrim(u, F.lit("/")))


def social_scores(cases: DataFrame, filtered: bool = True) -> DataFrame:
    """Before (``filtered=False``) or after leaving out the platforms' own accounts."""
    saved = F.coalesce("socials", F.array().cast(STRINGS))
    kept = F.filter(saved, lambda s: ~urls.is_platform_account(s)) if filtered else saved
    rows = cases.filter((F.size(_set(F.col("expected_socials"))) > 0) | (F.size(saved) > 0))
    fold = lambda c: F.transform(F.coalesce(c, F.array().cast(STRINGS)), normal_url)
    return set_scores(rows, fold(F.col("expected_socials")), fold(kept))


def case_counts(cases: DataFrame) -> DataFrame:
    """Projects with a right direct address, with any wrong one, with a right fallback and
    with an address of each wrong class."""
    c = F.col
    direct, expected = _set(c("emails")), _set(c("expected_direct_emails"))
    wrong = F.array_except(F.array_except(direct, _set(c("plausible_unconfirmed_emails"))), expected)
    strict = c("verification_status").isin(*STRICT)
    fallback = _set(c("expected_fallback_emails"))
    of_class = lambda name: F.exists(direct, lambda e: deny_class(e) == name)
    return cases.agg(
        count_where(strict, "verified"),
        count_where(strict & F.arrays_overlap(expected, direct), "with_direct"),
        count_where(strict & (F.size(wrong) > 0), "with_wrong"),
        count_where(F.size(fallback) > 0, "fallback_cases"),
        count_where(F.arrays_overlap(fallback, _set(c("fallback_emails"))), "with_fallback"),
        count_where(of_class("crowdfunding_platform"), "platform_as_direct"),
        count_where(of_class("agency"), "agency_as_direct"),
        count_where(of_class("url_shortener"), "shortener_as_direct"),
    )


# Job titles that stand for the same role.
ROLE_GROUPS = (
    ("ceo", "chief executive", "代表", "대표", "president", "managing director", "社長"),
    ("founder", "co-founder", "cofounder", "創業者", "创始人", "창업자", "owner"),
    ("sales", "sales director", "head of sales", "営業", "business development"),
    ("marketing", "marketing director", "cmo", "brand", "brand designer"),
    ("pr", "press", "media", "communications", "publicity", "広報"),
)


def role_relation(predicted: Column, expected: Column) -> Column:
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    p, e = norm(predicted), norm(expected)
    shared = any_of([contains_any(p, g) & contains_any(e, g) for g in ROLE_GROUPS])
    return (
        F.when(p == "", "missing")
        .when((p == e) | ((e != "") & (F.contains(p, e) | F.contains(e, p))), "exact")
        .when(shared, "compatible")
        .otherwise("mismatch")
    )


def people_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """``(project_id, name, role)`` on both sides: name counts and role relations."""
    fold = lambda df, role: df.select(
        "project_id", F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))).alias("name"), F.col("role").alias(role)
    ).groupBy("project_id", "name").agg(F.max(role).alias(role))
    e = fold(expected, "expected_role").withColumn("in_e", F.lit(True))
    p = fold(predicted, "predicted_role").withColumn("in_p", F.lit(True))
    both = e.join(p, ["project_id", "name"], "full").fillna(False, ["in_e", "in_p"])
    relation = F.when(F.col("in_e") & F.col("in_p"), role_relation(F.col("predicted_role"), F.col("expected_role")))
    rows = both.withColumn("relation", relation)
    return prf(
        rows.agg(
            F.count_distinct("project_id").alias("n"), count_where(F.col("in_e") & F.col("in_p"), "tp"), count_where(~F.col("in_e") & F.col("in_p"), "fp"),
            count_where(F.col("in_e") & ~F.col("in_p"), "fn"), *[count_where(F.col("relation") == k, k) for k in ("exact", "compatible", "mismatch", "missing")],
        )
    )


# --- qualification ---------------------------------------------------------------------------

COUNTED = ("verified", "partially_verified")


def qualification_rows(research: DataFrame, outreach: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per case from the two qualified stages and the labels (keyed by
    ``project_id``), with finding counts."""
    open_ = lambda f: f["severity"].isin("blocker", "review")
    proof = lambda f: F.filter(
        f["evidence"],
        lambda e: (F.coalesce(e["claim"], F.lit("")) != "") & (F.coalesce(e["source_url"], F.lit("")) != "") & (F.coalesce(e["method"], F.lit("")) != "") & e["checked_at"].isNotNull(),
    )
    r = research.select("project_id", F.col("decision").alias("pre_research"), "blocker_codes", "review_codes", F.col("findings").alias("f1"))
    o = outreach.select("project_id", F.col("decision").alias("pre_outreach"), F.col("findings").alias("f2"))
    rows = r.join(o, "project_id").join(labels, "project_id").withColumn("all", F.concat("f1", "f2"))
    stops = F.filter("all", open_)
    return rows.withColumns(
        {
            "n_stops": F.size(stops),
            "n_proved": F.size(F.filter(stops, lambda f: F.size(proof(f)) > 0)),
            "n_internal": F.size(F.filter(stops, lambda f: (F.size(proof(f)) > 0) & F.forall(proof(f), lambda e: e["method"] == "db_state"))),
            "n_stale": F.size(F.filter("all", lambda f: f["verdict"] == "stale")),
        }
    ).drop("f1", "f2", "all")


def qualification_metrics(rows: DataFrame) -> DataFrame:
    """Metrics as ``(metric, numerator, denominator, percent)``. Unknown labels leave
    the denominators."""
    c = F.col
    counted = rows.filter(c("verification_status").isin(*COUNTED))
    blocked = c("pre_research") == "blocked"
    want, allow = c("should_research"), c("should_allow_outreach")
    pairs = {
        "over_exclusion": (want & blocked, want),
        "wrong_outreach_allow": (~allow & (c("pre_outreach") == "clear"), ~allow),
        **{f"{d}_precision": ((c("pre_research") == d) & (c("expected_pre_research") == d), c("pre_research") == d) for d in ("blocked", "review", "clear")},
        "match_pre_research": (c("pre_research") == c("expected_pre_research"), F.lit(True)),
        "match_pre_outreach": (c("pre_outreach") == c("expected_pre_outreach"), F.lit(True)),
        "manual_review_needed": (c("pre_research") == "review", F.lit(True)),
        "internal_only": (c("n_internal") > 0, F.lit(True)),
        "stale": (c("n_stale") > 0, F.lit(True)),
        "override_candidate": (allow & (c("pre_outreach") != "clear"), allow),
        "undecidable": (~F.coalesce(c("evidence_sufficient"), F.lit(False)), F.lit(True)),
    }
    measures = []
    for name, (num, den) in pairs.items():
        measures += [count_where(num, f"{name}__n"), count_where(den, f"{name}__d")]
    measures += [F.coalesce(F.sum("n_proved"), F.lit(0)).alias("evidence_sufficiency__n"), F.coalesce(F.sum("n_stops"), F.lit(0)).alias("evidence_sufficiency__d")]
    measures += [(F.count_if(blocked) - F.count_if(want & blocked)).alias("net_reduction__n"), F.count_if(blocked).alias("net_reduction__d")]
    one = counted.agg(*measures)
    names = [*pairs, "evidence_sufficiency", "net_reduction"]
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), c(f"{n}__n").alias("numerator"), c(f"{n}__d").alias("denominator")) for n in names])
    return one.select(F.explode(entries).alias("m")).select("m.*").withColumn("percent", ratio_percent(c("numerator"), c("denominator")))


def stop_reasons(rows: DataFrame) -> DataFrame:
    counted = rows.filter(F.col("verification_status").isin(*COUNTED))
    return counted.select(F.explode(F.concat("blocker_codes", "review_codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def metrics_by_site(rows: DataFrame) -> DataFrame:
    counted = rows.filter(F.col("verification_status").isin(*COUNTED))
    out = counted.groupBy("source_site").agg(
        F.count(F.lit(1)).alias("n"),
        *[count_where(F.col(s) == d, f"{s}_{d}") for s in ("pre_research", "pre_outreach") for d in ("blocked", "review", "clear")],
        count_where(F.col("pre_research") == F.col("expected_pre_research"), "match_pre_research"),
        count_where(F.col("pre_outreach") == F.col("expected_pre_outreach"), "match_pre_outreach"),
    )
    return out.withColumn("match_percent", ratio_percent(F.col("match_pre_research"), F.col("n")))


def input_problems(cases: DataFrame, labels: DataFrame, quotas: DataFrame, required) -> DataFrame:
    """Every violated expectation of an evaluation set as ``(check, detail)``; empty when
    the set is sound."""
    dup = lambda df, key, name: df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(F.lit(name).alias("check"), F.col(key).cast("string").alias("detail"))
    only = lambda a, b, name: a.join(b.select("case_id"), "case_id", "left_anti").select(F.lit(name).alias("check"), F.col("case_id").cast("string").alias("detail"))
    sizes = cases.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))
    off = quotas.join(sizes, "source_site", "full").filter(~F.coalesce(F.col("n"), F.lit(0)).eqNullSafe(F.coalesce(F.col("quota"), F.lit(0))))
    blank = [
        labels.filter(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")).select(F.lit(f"missing_{f}").alias("check"), F.col("case_id").cast("string").alias("detail"))
        for f in required
    ]
    parts = [
        dup(cases, "case_id", "duplicate_case_id"), dup(cases, "canonical_maker_key", "duplicate_maker_key"), only(cases, labels, "case_without_label"),
        only(labels, cases, "label_without_case"), off.select(F.lit("site_quota").alias("check"), F.col("source_site").alias("detail")), *blank,
    ]
    return reduce(DataFrame.unionByName, parts)


# --- label validation ---------------------------------------------------------------------------

# Fixed values.
LABEL_STATUSES = ("confirmed", "none", "ambiguous", "unreachable", "excluded")
LABEL_EVIDENCE = (
    "campaign_outbound_link", "legal_company_page", "product_brand_page", "official_social_link",
    "trademark_brand_record", "marketplace_profile", "manual_other", "",
)
LABEL_CONFIDENCE = ("high", "medium", "low", "")
PROFILE_HOSTS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "youtu.be", "tiktok.com",
    "pinterest.com", "linkedin.com", "reddit.com", "threads.net", "weibo.com",
)
LINK_HUBS = (
    "linktr.ee", "lnk.bio", "linkin.bio", "campsite.bio", "beacons.ai", "taplink.cc", "solo.to",
    "linkpop.com", "lit.link", "bio.link", "potofu.me",
)
EMAIL_TEXT = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE_TEXT = r"(?<!\d)(\+?\d[\d\-\s().]{7,}\d)(?!\d)"
SECRET_TEXT = (
    r"(?i)(api[_-]?key|secret|token|bearer|password|cookie|authorization)\s*[:=]"
    r"|sk_live_|ghp_|xox[baprs]-|AKIA[0-9A-Z]{16}"
)
PRIVATE_HOST = r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|24\d\.|25[0-5]\.)[\d.]+$"


def with_scheme(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when((u == "") | u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), u).otherwise(F.concat(F.lit("https://"), u))


def label_url_reason(url: Column) -> Column:
    raw = F.trim(F.coalesce(url, F.lit("")))
    u = with_scheme(raw)
    scheme, host = urls.scheme(u), F.substring_index(urls.netloc(u), ":", 1)
    return (
        F.when(raw == "", F.lit(None))
        .when(F.contains(raw, F.lit("@")) & ~F.contains(raw, F.lit("://")), "email_not_url")
        .when(~scheme.isin("http", "https"), F.concat(F.lit("invalid_scheme:"), scheme))
        .when(host == "", "invalid_host")
        .when((host == "localhost") | F.endswith(host, F.lit(".local")), "localhost")
        .when(host.rlike(PRIVATE_HOST), "private_ip")
        .when(~F.contains(host, F.lit(".")), "invalid_host")
    )


def label_url_warnings(url: Column) -> Column:
    u = with_scheme(url)
    reg, host = urls.registrable_domain(u), urls.host_of(u)
    return F.array_compact(
        F.array(
            F.when(reg.isin(*vocab.CROWDFUNDING_PLATFORMS), F.lit("platform_url")),
            F.when(reg.isin(*vocab.RETAILERS), F.lit("marketplace_url")),
            F.when(reg.isin(*PROFILE_HOSTS) | urls.under_any(host, PROFILE_HOSTS), F.lit("sns_url")),
            F.when(reg.isin(*LINK_HUBS), F.lit("linktree_url")),
            F.when(reg.isin(*vocab.CROWDFUNDING_MARKETING, *vocab.KNOWN_AGENCIES), F.lit("marketing_or_agency_url")),
        )
    )


def private_data(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(t.rlike(EMAIL_TEXT), F.lit("email")),
            F.when(F.regexp_replace(t, r"https?://\S+", " ").rlike(PHONE_TEXT), F.lit("phone")),
            F.when(t.rlike(SECRET_TEXT), F.lit("secret")),
        )
    )


def label_errors(c=F.col) -> Column:
    """Errors of one reviewed label row; rows without a status are not checked."""
    val = lambda name: F.trim(F.coalesce(c(name), F.lit("")))
    status, url, reg = val("gt_status"), val("gt_official_url"), val("gt_registered_domain")
    need = lambda cond, names: [F.when(cond & (val(n) == ""), F.lit(f"missing:{n}")) for n in names]
    confirmed, negative, open_ = status == "confirmed", status.isin("none", "excluded"), status.isin("ambiguous", "unreachable")
    actual = urls.registrable_domain(with_scheme(url))
    refused = label_url_reason(url)
    leaks = [
        F.when(F.size(private_data(c(n))) > 0, F.concat(F.lit(f"private_data:{n}:"), F.array_join(private_data(c(n)), ",")))
        for n in ("gt_official_url", "evidence_url", "reviewer_note")
    ]
    checks = [
        F.when(~status.isin(*LABEL_STATUSES), F.lit("invalid:gt_status")),
        F.when(~val("evidence_type").isin(*LABEL_EVIDENCE), F.lit("invalid:evidence_type")),
        F.when(~val("confidence").isin(*LABEL_CONFIDENCE), F.lit("invalid:confidence")),
        *need(confirmed, ("gt_official_url", "gt_registered_domain", "evidence_type", "evidence_url", "reviewer_note", "confidence")),
        F.when(confirmed & (url != "") & (reg != "") & (actual != reg), F.lit("domain_mismatch")),
        F.when(negative & (url != ""), F.lit("unexpected:gt_official_url")),
        F.when(negative & (reg != ""), F.lit("unexpected:gt_registered_domain")),
        *need(negative | open_, ("reviewer_note",)),
        F.when(refused.isNotNull(), F.concat(F.lit("url_rejected:"), refused)),
        *leaks,
    ]
    return F.when(status == "", F.array().cast(STRINGS)).otherwise(F.array_compact(F.array(*checks)))


def label_progress(labels: DataFrame) -> DataFrame:
    status = F.trim(F.coalesce("gt_status", F.lit("")))
    return labels.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("total"), count_where(status != "", "reviewed"), count_where(status == "", "unreviewed"),
        *[count_where(status == s, f"n_{s}") for s in LABEL_STATUSES],
    )

"""Contact-search gate, lead qualification A–T and the pre-outreach decision.

Everything is row-wise over one signals row: rules are struct columns collected in
an array, so qualifying the whole table is one narrow stage without a shuffle.
Reasons and claims are codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates
from leadloom.functions.text import any_of, codes, contains_any, has_term, joined_lower, match_categories
from leadloom.functions.urls import lit_array

EVIDENCE = (
    "struct<claim:string,source_url:string,source_kind:string,method:string,"
    "checked_at:timestamp,excerpt:string>"
)
EVIDENCES = f"array<{EVIDENCE}>"
STAGES = ("pre_research", "pre_outreach")


def _bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- contact-search gate ------------------------------------------------------------

def is_non_physical(text: Column) -> Column:
    weak = has_term(text, vocab.NON_PHYSICAL_WEAK) & ~has_term(text, vocab.PHYSICAL_HINTS)
    return has_term(text, vocab.NON_PHYSICAL_STRONG) | weak


def excluded_categories(text: Column) -> Column:
    caution = match_categories(text, vocab.CAUTION_CATEGORIES)
    return codes(
        ("non_physical", is_non_physical(text)),
        ("b2b", contains_any(text, vocab.B2B_HINTS)),
        ("bulky", contains_any(text, vocab.BULKY_HINTS)),
        ("medical_claim", contains_any(text, vocab.MEDICAL_CLAIM_HINTS)),
        ("dangerous", contains_any(text, vocab.DANGEROUS_HINTS)),
        ("heavy_regulation", F.arrays_overlap(caution, lit_array(vocab.HEAVY_REGULATION))),
    )


def appeal_points(text: Column) -> Column:
    points = match_categories(text, vocab.APPEAL_HINTS)
    fallback = F.size(match_categories(text, vocab.HIGH_FIT_CATEGORIES)) > 0
    return F.when(F.size(points) > 0, points).when(fallback, F.array(F.lit("convenience"))).otherwise(points)


def contact_search_gate(rows: DataFrame) -> DataFrame:
    """``rows`` has title, description, category, campaign_url, japanese_summary and
    makuake_fit. Adds ``gate_decision``, ``gate_blockers`` and ``gate_reasons``."""
    staged = rows.withColumn("_text", joined_lower(F.col("title"), F.col("description"), F.col("category")))
    staged = staged.withColumns(
        {"_excluded": excluded_categories(F.col("_text")), "_appeal": appeal_points(F.col("_text"))}
    )
    no_page = F.col("campaign_url").isNull()
    no_summary = F.length(F.coalesce(F.col("japanese_summary"), F.lit(""))) < vocab.MIN_SUMMARY_LENGTH
    blockers = F.concat(
        codes(("no_campaign_url", no_page), ("no_summary", no_summary)),
        F.col("_excluded"),
        codes(("no_appeal", F.size("_appeal") == 0)),
    )
    score = F.col("makuake_fit")
    decision = (
        F.when(no_page | no_summary, "not_eligible")
        .when(F.size(blockers) > 0, "needs_review")
        .when(score.isNull(), "needs_review")
        .when(score >= vocab.GATE_SCORE, "eligible")
        .when(score >= vocab.GATE_REVIEW_FLOOR, "needs_review")
        .otherwise("not_eligible")
    )
    low = F.size(blockers) == 0
    extra = codes(
        ("score_unknown", low & score.isNull()),
        ("fit_unconfirmed", low & (score < vocab.GATE_SCORE)),
    )
    return staged.withColumns(
        {"gate_decision": decision, "gate_blockers": blockers, "gate_reasons": F.concat(blockers, extra)}
    ).drop("_text", "_excluded", "_appeal")


def _squeezed(reason: Column) -> Column:
    """Reason without bracketed remarks and blanks."""
    bare = F.regexp_replace(reason, r"[（(][^）)]*[）)]", "")
    return F.regexp_replace(bare, r"\s+", "")


def merge_reasons(existing: Column, added: Column) -> Column:
    """Append reasons that do not repeat one already there; a reason repeats another
    when one contains the other after squeezing. Order is kept."""

    def step(acc, reason):
        squeezed = _squeezed(reason)
        seen = F.exists(
            acc,
            lambda r: (_squeezed(r) != "")
            & (F.contains(_squeezed(r), squeezed) | F.contains(squeezed, _squeezed(r))),
        )
        return F.when((squeezed == "") | seen, acc).otherwise(F.concat(acc, F.array(reason)))

    return F.aggregate(added, existing, step)


GATE_RANK = {"not_eligible": 0, "needs_review": 1, "eligible": 2}


def merge_gate(gate_decision: Column, gate_reasons: Column, decision: Column, reasons: Column) -> dict[str, Column]:
    """Qualification can only make the gate stricter."""
    merged = F.when(decision == "blocked", F.lit("not_eligible")).otherwise(gate_decision)
    speaks = decision.isin("blocked", "review")
    return {
        "gate_decision": merged,
        "eligible": merged == "eligible",
        "reasons": F.when(speaks, merge_reasons(gate_reasons, reasons)).otherwise(gate_reasons),
    }


# --- evidence -------------------------------------------------------------------------

def evidence(claim: str, url, kind, method, checked_at, excerpt=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(claim).alias("claim"),
        as_col(url).cast("string").alias("source_url"),
        as_col(kind).cast("string").alias("source_kind"),
        as_col(method).cast("string").alias("method"),
        as_col(checked_at).cast("timestamp").alias("checked_at"),
        as_col(excerpt).cast("string").alias("excerpt"),
    )


def none() -> Column:
    return F.array().cast(EVIDENCES)


def is_complete(e: Column) -> Column:
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return filled(e["claim"]) & filled(e["source_url"]) & filled(e["method"]) & e["checked_at"].isNotNull()


def complete(evidences: Column) -> Column:
    return F.filter(evidences, is_complete)


def max_age_days(code: Column) -> Column:
    out = None
    for c, days in vocab.EVIDENCE_MAX_AGE_DAYS.items():
        out = F.when(code == c, days) if out is None else out.when(code == c, days)
    return out.otherwise(vocab.EVIDENCE_MAX_AGE_DEFAULT)


def is_fresh(e: Column, code: Column, now: Column) -> Column:
    """State evidence is read on the spot and never stale."""
    limit = now - F.make_dt_interval(max_age_days(code))
    return (e["method"] == "db_state") | (e["checked_at"] >= limit)


def _listings(items: Column, claim: str, kind: str) -> Column:
    """All listing pages as evidence. Items without a URL prove nothing."""
    some = F.filter(F.coalesce(items, F.array().cast(_LISTINGS)), lambda x: F.coalesce(x["url"], F.lit("")) != "")
    return F.transform(some, lambda x: evidence(claim, x["url"], kind, x["method"], x["checked_at"], x["excerpt"]))


_LISTINGS = "array<struct<url:string,checked_at:timestamp,method:string,excerpt:string>>"


def finding(code: str, verdict, severity, confidence, evidences, role="unknown") -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(code).alias("code"),
        as_col(verdict).alias("verdict"),
        as_col(severity).alias("severity"),
        as_col(confidence).alias("confidence"),
        F.coalesce(evidences, none()).alias("evidence"),
        as_col(role).alias("entity_role"),
    )


def _no_hit(code: str) -> Column:
    return finding(code, "no_hit", "info", "unverified", none())


# --- rules A–T ----------------------------------------------------------------------------

def _analysis(signals: DataFrame) -> DataFrame:
    """Text facts every rule reads, computed once per row."""
    c = F.col
    staged = signals.withColumn("_text", joined_lower(c("title"), c("description"), c("category")))
    text = c("_text")
    facts = {"_caution": match_categories(text, vocab.CAUTION_CATEGORIES), "_physical": has_term(text, vocab.PHYSICAL_HINTS)}
    for code in ("N", "O", "P"):
        facts[f"_strong_{code}"] = has_term(text, vocab.QUALIFY_STRONG[code])
        facts[f"_weak_{code}"] = has_term(text, vocab.QUALIFY_WEAK[code])
    facts["_bulky"] = has_term(text, vocab.BULKY_HINTS)
    facts["_non_product"] = has_term(text, vocab.QUALIFY_NON_PRODUCT)
    facts["_mega"] = _bool(has_term(F.lower(c("maker_name")), vocab.QUALIFY_MEGA_BRANDS))
    return staged.withColumns(facts)


def _rules(stage: str, now: Column) -> list[Column]:
    c = F.col
    early = stage == "pre_research"
    sev = lambda a, b: a if early else b
    page = c("campaign_url")

    def on_page(claim):
        return F.when(page.isNotNull(), F.array(evidence(claim, page, "campaign", "campaign_page_parse", now))).otherwise(none())

    def state(claim, anchor):
        where = F.concat(F.lit("db://projects/"), c("project_id").cast("string"), F.lit("#" + anchor) if isinstance(anchor, str) else F.concat(F.lit("#"), anchor))
        return evidence(claim, where, "internal_db", "db_state", now, anchor if isinstance(anchor, Column) else anchor)

    has_page_conf = F.when(page.isNotNull(), "low").otherwise("unverified")
    heavy = F.arrays_overlap(c("_caution"), lit_array(vocab.HEAVY_REGULATION))
    rule_a = F.when(
        heavy | c("_bulky"), finding("A", "hit", sev("review", "info"), has_page_conf, on_page("market_concern"))
    ).otherwise(_no_hit("A"))

    listed = _listings(c("japan_cf_listings"), "listed_on_domestic_crowdfunding", "jp_crowdfunding")
    rule_b = (
        F.when(F.size(listed) > 0, finding("B", "hit", sev("blocker", "info"), "high", listed))
        .when(c("_non_product"), finding("B", "hit", sev("review", "info"), "low", on_page("non_product_terms")))
        .otherwise(_no_hit("B"))
    )

    notice = c("oem_notice")
    noticed = _bool(notice["source_url"] != "")
    low = F.lower(F.coalesce(notice["excerpt"], F.lit("")))
    role_in_notice = (
        F.when(has_term(low, ("odm",)), "odm")
        .when(has_term(low, ("oem",)), "oem")
        .when(contains_any(low, ("private label", "white label")), "private_label")
        .when(contains_any(low, ("contract manufacturer", "受託製造")), "manufacturer")
        .otherwise("unknown")
    )
    notice_ev = F.when(
        noticed,
        F.array(evidence("oem_notice", notice["source_url"], "campaign", notice["method"], notice["checked_at"], notice["excerpt"])),
    ).otherwise(none())
    others = _listings(c("other_brand_listings"), "sold_under_other_brand", "shop")
    several = F.size(others) >= 2
    role = F.when(noticed & (role_in_notice != "unknown"), role_in_notice).when(several, "private_label").otherwise("unknown")
    rule_c = (
        F.when(noticed | several, finding("C", "hit", "review", "medium", F.concat(notice_ev, F.when(several, others).otherwise(none())), role))
        .when(F.size(others) > 0, finding("C", "insufficient_evidence", "info", "unverified", others))
        .otherwise(_no_hit("C"))
    )

    creator = c("creator_domain")
    reseller = creator["ownership_class"].isin(*vocab.RESELLER_CLASSES)
    creator_ev = F.array(
        evidence(
            "creator_is_reseller", creator["url"], "distributor", F.coalesce(creator["method"], F.lit("classify_domain")),
            creator["checked_at"], creator["ownership_class"],
        )
    )
    rule_d = (
        F.when(
            F.coalesce(creator["ownership_class"], F.lit("")) == "",
            finding("D", "insufficient_evidence", sev("info", "review"), "unverified", none()),
        )
        .when(reseller, finding("D", "hit", sev("review", "blocker"), "high", creator_ev, creator["ownership_class"]))
        .otherwise(_no_hit("D"))
    )

    named = F.trim(F.coalesce(c("maker_name"), F.lit(""))) != ""
    anchor = F.when(named, "maker_identity").otherwise("maker_name")
    severity_e = F.when(named, "info").otherwise("review") if early else F.lit("blocker")
    rule_e = F.when(_bool(c("maker_identity")["verified"]), _no_hit("E")).otherwise(
        finding("E", "hit", severity_e, "high", F.array(state("maker_identity_open", anchor)))
    )

    japan = c("japan_sales")
    sold_on = F.filter(
        F.coalesce(japan["channels"], F.array().cast("array<struct<channel:string,label:string,status:string,search_url:string,note:string>>")),
        lambda ch: F.lower(ch["status"]).isin("found", "limited")
        & any_of([F.contains(F.lower(ch["channel"]), F.lit(k)) for k in vocab.PRESENCE_CHANNELS])
        & (F.coalesce(ch["search_url"], F.lit("")) != ""),
    )
    sold_ev = F.transform(sold_on, lambda ch: evidence("sold_in_japan", ch["search_url"], "shop", "japan_sales_check", japan["checked_at"], ch["channel"]))
    urls_of = lambda claim: F.transform(
        F.filter(F.coalesce(japan["source_urls"], F.array().cast("array<string>")), lambda u: u != ""),
        lambda u: evidence(claim, u, "shop", "japan_sales_check", japan["checked_at"]),
    )
    rule_f = (
        F.when(
            (japan["result"] == "sold_in_japan") & (F.size(sold_ev) > 0), finding("F", "hit", "blocker", "high", sold_ev)
        )
        .when(japan["result"] == "sold_in_japan", finding("F", "hit", "review", "medium", urls_of("sale_suggested")))
        .when(japan["result"] == "not_found_in_japan", finding("F", "no_hit", "info", "low", urls_of("not_found_in_japan")))
        .otherwise(finding("F", "insufficient_evidence", "info", "unverified", none()))
    )

    def regulated(code):
        hit = F.arrays_overlap(c("_caution"), lit_array(vocab.QUALIFY_REGULATED[code]))
        return hit, F.when(hit, finding(code, "hit", sev("review", "info"), "low", on_page("regulated_terms"))).otherwise(_no_hit(code))

    reg = {code: regulated(code) for code in ("H", "I", "J", "K", "L")}
    radio = reg["K"][0]
    rule_m = F.when(radio, finding("M", "hit", sev("review", "info"), "low", on_page("regulated_terms"))).otherwise(_no_hit("M"))
    hits = [reg[k][0] for k in "HIJKL"] + [radio]
    rolled = F.flatten(F.array(*[F.when(h, on_page("regulated_terms")).otherwise(none()) for h in hits]))
    rule_g = F.when(any_of(hits), finding("G", "hit", "info", "low", rolled)).otherwise(_no_hit("G"))

    def non_physical(code):
        strong, weak = c(f"_strong_{code}"), c(f"_weak_{code}")
        return (
            F.when(strong, finding(code, "hit", "blocker", "low", on_page("non_physical_terms")))
            .when(weak & ~c("_physical"), finding(code, "insufficient_evidence", "review", "low", on_page("maybe_non_physical")))
            .otherwise(_no_hit(code))
        )

    gone = c("discontinued_notice")
    gone_ev = F.array(evidence("discontinued", gone["source_url"], "official_site", gone["method"], gone["checked_at"], gone["excerpt"]))
    ended = c("end_date").cast("timestamp") < now
    no_site = F.coalesce(c("official_site")["url"], F.lit("")) == ""
    rule_q = (
        F.when(F.coalesce(gone["source_url"], F.lit("")) != "", finding("Q", "hit", sev("blocker", "review"), "high", gone_ev))
        .when(ended & no_site, finding("Q", "insufficient_evidence", "review", "low", F.array(state("campaign_ended", "end_date"))))
        .otherwise(_no_hit("Q"))
    )

    sold_at = _listings(c("global_listings"), "widely_sold", "shop")
    rule_r = (
        F.when(F.size(complete(sold_at)) >= 3, finding("R", "hit", sev("blocker", "info"), "high", sold_at))
        .when(c("_mega"), finding("R", "hit", sev("review", "info"), "low", F.array(state("mega_brand_name", "maker_name"))))
        .when(F.size(sold_at) > 0, finding("R", "insufficient_evidence", "info", "unverified", sold_at))
        .otherwise(_no_hit("R"))
    )

    verified_site = _bool(c("official_site")["verified"]) & ~no_site
    severity_s = F.when(no_site, "info").otherwise("review") if early else F.lit("review")
    rule_s = F.when(verified_site, _no_hit("S")).otherwise(
        finding("S", "hit", severity_s, "high", F.array(state("official_site_open", "official_site")))
    )

    no_summary = F.length(F.trim(F.coalesce(c("japanese_summary"), F.lit("")))) < vocab.MIN_SUMMARY_LENGTH
    gaps = F.array_compact(
        F.array(
            F.when(F.coalesce(page, F.lit("")) == "", state("campaign_url_missing", "campaign_url")),
            F.when(no_summary, state("summary_missing", "japanese_summary")),
        )
    )
    rule_t = F.when(F.size(gaps) > 0, finding("T", "hit", "blocker", "high", gaps)).otherwise(_no_hit("T"))
    return [
        rule_a, rule_b, rule_c, rule_d, rule_e, rule_f, rule_g, *[reg[k][1] for k in "HIJKL"], rule_m,
        *[non_physical(k) for k in "NOP"], rule_q, rule_r, rule_s, rule_t,
    ]


def enforce_invariants(f: Column, now: Column) -> Column:
    """A blocker needs a hit, one complete and one fresh piece of evidence; otherwise
    it becomes a review and the cause is kept."""
    proof = complete(f["evidence"])
    fresh = F.filter(proof, lambda e: is_fresh(e, f["code"], now))
    blocker = f["severity"] == "blocker"
    cause = (
        F.when(blocker & (f["verdict"] != "hit"), "verdict_not_hit")
        .when(blocker & (F.size(proof) == 0), "evidence_incomplete")
        .when(blocker & (F.size(fresh) == 0), "evidence_stale")
    )
    return F.struct(
        f["code"].alias("code"),
        F.when(cause == "evidence_stale", "stale").otherwise(f["verdict"]).alias("verdict"),
        F.when(cause.isNotNull(), "review").otherwise(f["severity"]).alias("severity"),
        f["confidence"].alias("confidence"),
        f["evidence"].alias("evidence"),
        f["entity_role"].alias("entity_role"),
        F.when(cause.isNotNull(), "blocker").alias("downgraded_from"),
        cause.alias("downgrade_reason"),
    )


def positive_facts(now: Column) -> Column:
    """Eight facts, each kept only with complete evidence."""
    c = F.col
    page, site, who, japan = c("campaign_url"), c("official_site"), c("maker_identity"), c("japan_sales")
    no_strong = ~any_of([c(f"_strong_{k}") for k in "NOP"])
    where = F.concat(F.lit("db://projects/"), c("project_id").cast("string"), F.lit("#maker_name"))
    people_of = lambda items, claim, name: F.transform(
        F.filter(items, lambda x: F.coalesce(x[name], F.lit("")) != ""),
        lambda x: evidence(claim, x["source_url"], "official_site", x["method"], x["checked_at"]),
    )
    one = lambda cond, e: F.when(cond, F.array(e)).otherwise(none())
    facts = {
        "campaign_url_verified": one(page.isNotNull(), evidence("campaign_url", page, "campaign", "db_state", now)),
        "physical_product_confirmed": one(
            c("_physical") & no_strong & page.isNotNull(), evidence("physical_terms", page, "campaign", "campaign_page_parse", now)
        ),
        "maker_name_present": one(
            F.trim(F.coalesce(c("maker_name"), F.lit(""))) != "", evidence("maker_name", where, "internal_db", "db_state", now)
        ),
        "official_site_verified": one(
            _bool(site["verified"]) & (F.coalesce(site["url"], F.lit("")) != ""),
            evidence("official_site", F.coalesce(site["source_url"], site["url"]), "official_site", site["method"], site["checked_at"]),
        ),
        "maker_identity_verified": one(
            _bool(who["verified"]), evidence("maker_identity", who["source_url"], "official_site", who["method"], who["checked_at"])
        ),
        "business_contact_found": F.coalesce(people_of(c("business_emails"), "business_email", "email"), none()),
        "decision_maker_found": F.coalesce(people_of(c("decision_makers"), "decision_maker", "name"), none()),
        "japan_sales_check_completed": one(
            japan["status"] == "completed",
            evidence("japan_check", F.get(japan["source_urls"], 0), "shop", "japan_sales_check", japan["checked_at"]),
        ),
    }
    rows = [F.struct(F.lit(k).alias("key"), complete(ev).alias("evidence")) for k, ev in facts.items()]
    return F.filter(F.array(*rows), lambda f: F.size(f["evidence"]) > 0)


def qualify(signals: DataFrame, stage: str, as_of) -> DataFrame:
    """Adds findings, positive_facts, decision, blocker_codes, review_codes and
    evidence_count for one stage."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    now = dates.timestamp_lit(as_of)
    rows = _analysis(signals).withColumns({"findings": F.array(*_rules(stage, now)), "positive_facts": positive_facts(now)})
    rows = rows.withColumn("findings", F.transform(F.col("findings"), lambda f: enforce_invariants(f, now)))
    of = lambda severity: F.transform(F.filter("findings", lambda f: f["severity"] == severity), lambda f: f["code"])
    rows = rows.withColumns({"blocker_codes": of("blocker"), "review_codes": of("review")})
    decision = (
        F.when(F.size("blocker_codes") > 0, "blocked").when(F.size("review_codes") > 0, "review").otherwise("clear")
    )
    count = lambda col, acc: F.aggregate(F.col(col), F.lit(0), lambda n, f: n + F.size(acc(f["evidence"])))
    rows = rows.withColumns(
        {
            "stage": F.lit(stage),
            "decision": decision,
            "evidence_count": count("findings", complete) + count("positive_facts", lambda e: e),
            "evaluated_at": now,
        }
    )
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def findings_table(qualified: DataFrame) -> DataFrame:
    """One row per finding, heaviest first within a project by (severity, code)."""
    # never empty, so the outer form only spares the planner a filter on the whole rule set
    return qualified.select("project_id", "stage", F.explode_outer("findings").alias("f")).select("project_id", "stage", "f.*")


def history_rows(qualified: DataFrame) -> DataFrame:
    """Rows to append to the qualification history."""
    return qualified.select(
        "project_id", "stage", "decision", F.col("decision").alias("machine_decision"), F.lit(False).alias("overridden"),
        "blocker_codes", "review_codes", "findings", "positive_facts", "evidence_count", F.col("evaluated_at").alias("created_at"),
        F.lit(None).cast("string").alias("override_reason"), F.lit(None).cast("string").alias("override_evidence_url"),
    )


def override_rows(history: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(project_id, new_decision, reason, evidence_url)`` as history rows:
    the human decision is stored, machine codes and evidence count stay."""
    o = overrides.select("project_id", "new_decision", "reason", "evidence_url")
    return (
        history.join(o, "project_id")
        .withColumns({"decision": F.col("new_decision"), "overridden": F.lit(True), "override_reason": F.col("reason"), "override_evidence_url": F.col("evidence_url")})
        .drop("new_decision", "reason", "evidence_url")
    )


def signals_digest(fields: dict[str, Column], emails: Column | None = None) -> Column:
    """SHA-256 over a canonical JSON: fields in name order, NULL and empty alike,
    addresses reduced to their domain."""
    canon = {k: F.nullif(v.cast("string"), F.lit("")) for k, v in fields.items()}
    if emails is not None:
        canon["business_email_domains"] = F.array_join(
            F.transform(emails, lambda e: F.substring_index(F.lower(e), "@", -1)), ","
        )
    body = F.to_json(F.struct(*[canon[k].alias(k) for k in sorted(canon)]))
    return F.sha2(body, 256)


def outreach_reuse(latest: DataFrame, digests: DataFrame, as_of) -> DataFrame:
    """What to do before writing to a lead: ``override``, ``reuse`` or ``evaluate``.

    ``latest`` is the newest pre-outreach history row per project (with ``digest`` and
    ``has_stale``), ``digests(project_id, digest)`` the current inputs. A project
    without current inputs is ``unavailable``: it fails closed.
    """
    now = dates.timestamp_lit(as_of)
    rows = digests.select("project_id", F.col("digest").alias("current_digest")).join(latest, "project_id", "left")
    same = F.col("digest") == F.col("current_digest")
    within = lambda h: F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(h))
    valid = (
        F.col("overridden")
        & (F.col("decision") == "clear")
        & (F.trim(F.coalesce(F.col("override_reason"), F.lit(""))) != "")
        & F.col("override_evidence_url").rlike(r"^\s*https?://")
        & within(72)
        & same
        & ~F.col("has_stale")
    )
    action = (
        F.when(F.col("current_digest").isNull(), "unavailable")
        .when(_bool(valid), "override")
        .when(_bool(same & within(24)), "reuse")
        .otherwise("evaluate")
    )
    return rows.withColumn("action", action).withColumn(
        "outcome", F.when(F.col("action") == "override", "clear").when(F.col("action") == "reuse", F.col("decision"))
    )


def regulatory_checks(text: Column) -> Column:
    """Import checks worth making, with the words that call for them."""
    items = [
        F.when(
            contains_any(text, words),
            F.struct(
                F.lit(item).alias("item"),
                F.array_sort(codes(*[(w, F.contains(text, F.lit(w))) for w in words])).alias("terms"),
            ),
        )
        for item, words in vocab.REGULATORY_CHECKS.items()
    ]
    return F.array_compact(F.array(*items))

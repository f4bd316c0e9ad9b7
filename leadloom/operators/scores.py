"""Rule scores and decisions as column expressions over a signals row.

Every score is a pure function of columns; sub-scores are materialised by a
``select`` before the score that reads them, because each stage rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import numbers
from leadloom.functions.numbers import clamp
from leadloom.functions.text import any_of, codes, contains_any, joined_lower, map_lookup, match_categories
from leadloom.functions.urls import lit_array



def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- sales priority --------------------------------------------------------------------

def sales_priority_score(
    *, latest_score, research_done, contact_available, email_done, raised, goal, backers, sales_status
) -> Column:
    rate = numbers.funding_ratio(raised, goal)
    base = F.least(F.greatest(F.coalesce(latest_score, F.lit(0)), F.lit(0)), F.lit(100)) * 0.4
    score = (
        base
        + F.when(contact_available, 20).otherwise(0)
        + F.when(email_done, 15).otherwise(0)
        + F.when(research_done, 10).otherwise(0)
        + F.when(rate >= 1.0, 5).when(F.coalesce(backers, F.lit(0)) >= 300, 3).otherwise(0)
        + 5
        - F.when(sales_status == "contacted", 40)
        .when(sales_status == "awaiting_reply", 20)
        .when(sales_status.isin(*vocab.DONE_STATUSES), 60)
        .otherwise(0)
    )
    return clamp(score)


def sales_priority_reasons(
    *, latest_score, research_done, contact_available, email_done, raised, goal, sales_status
) -> Column:
    rate = numbers.funding_ratio(raised, goal)
    return codes(
        ("scored", latest_score.isNotNull()),
        ("has_contact", contact_available),
        ("email_ready", email_done),
        ("researched", research_done),
        ("funded", rate >= 1.0),
        ("not_contacted", sales_status.isin(*vocab.READY_STATUSES)),
    )


def task_reasons(*, has_contact, has_email, availability, raised, goal, similar, days, group) -> Column:
    rate = numbers.funding_ratio(raised, goal)
    follow = (group == "followup") & days.isNotNull()
    return codes(
        ("has_contact", has_contact),
        ("email_ready", has_email),
        ("maybe_unsold_in_japan", availability.isin("not_landed", "possible")),
        ("funded_300", rate >= 3.0),
        ("funded", (rate >= 1.0) & (rate < 3.0)),
        ("similar_success", similar),
        ("final_followup", follow & (days >= 14)),
        ("followup_due", follow & (days < 14)),
    )


# --- fit assessment ----------------------------------------------------------------------

def achievement_percent(rate_pct: Column, raised: Column, goal: Column) -> Column:
    return F.coalesce(numbers.whole(rate_pct), numbers.funding_percent_truncated(raised, goal))


def assess_fit(signals: DataFrame) -> DataFrame:
    """Adds the three fit scores with sub-scores, ``overall``, ``fit_confidence`` and
    ``missing`` to a signals table (columns as in the signals schema)."""
    c = F.col
    staged = signals.withColumn("_text", joined_lower(c("title"), c("description"), c("category")))
    staged = staged.withColumns(
        {
            "_rate": achievement_percent(c("rate_pct"), c("raised"), c("goal")),
            "_high": match_categories(c("_text"), vocab.HIGH_FIT_CATEGORIES),
            "_caution": match_categories(c("_text"), vocab.CAUTION_CATEGORIES),
            "_maker": F.lower(F.coalesce(c("maker_name"), F.lit(""))),
            "_non_product": contains_any(c("_text"), vocab.NON_PRODUCT_HINTS),
        }
    )
    rate, backers = c("_rate"), c("backers")
    no_track = rate.isNull() & (backers.isNull() | (backers == 0))
    traction = (
        F.lit(40)
        + F.when(rate >= 100, 15).when(rate.isNotNull(), numbers.whole(rate / 100 * 15)).otherwise(0)
        + F.when(rate > 100, F.least(F.lit(30), F.floor((rate - 100) / 100) * 5)).otherwise(0)
        + F.when(backers != 0, F.least(F.lit(15), F.floor(backers / 100))).otherwise(0)
    )
    n_high, n_caution = F.size("_high"), F.size("_caution")
    heavy = F.arrays_overlap(c("_caution"), lit_array(vocab.HEAVY_LOGISTICS))
    stars = c("japan_stars")
    conf = F.coalesce(c("japan_confidence"), F.lit(0))
    openness = (
        F.when(c("japan_result") == "sold_in_japan", 18)
        .when(c("japan_result") == "not_found_in_japan", clamp(52 + conf * 0.35))
        .when(c("japan_result").isNotNull(), 50)
        .when(truthy(c("already_in_japan")), 20)
        .when(stars.isNotNull(), clamp(20 + stars * 16))
        .otherwise(48)
    )
    maker = c("_maker")
    padded = F.concat(F.lit(" "), maker, F.lit(" "))
    # a brand that equals the name or starts it is also a word of the padded name
    mega = any_of([F.contains(padded, F.lit(f" {b} ")) for b in vocab.MEGA_BRANDS])
    size = (
        F.when(mega, 18)
        .when(contains_any(maker, vocab.SMALL_MAKER_HINTS) | F.length(maker).between(1, 24), 82)
        .otherwise(55)
    )
    reach = F.when(truthy(c("has_contact")), 85).when(truthy(c("has_official_site")), 60).otherwise(30)
    n_favoured = F.size(F.array_intersect(c("_high"), lit_array(vocab.MAKUAKE_FAVOURED)))
    novelty = (
        F.when(truthy(c("on_makuake")), 15)
        .when(truthy(c("already_in_japan")), 35)
        .when(stars.isNotNull(), clamp(45 + stars * 10))
        .otherwise(60)
    )
    known_track = rate.isNotNull() | F.coalesce(backers != 0, F.lit(False))
    checked_points = (
        F.when(
            (c("japan_state") == "completed") & c("japan_result").isin("sold_in_japan", "not_found_in_japan"),
            F.least(F.lit(25), F.greatest(F.lit(0), 10 + numbers.whole(conf * 0.2))),
        )
        .when(c("japan_result") == "inconclusive", 5)
        .when(c("japan_state").isNull() & truthy(c("japan_checked")), 25)
        .otherwise(0)
    )
    long_text = F.length(F.coalesce(c("description"), F.lit(""))) >= 40
    subs = staged.withColumns(
        {
            "category_appeal": clamp(52 + 12 * n_high - 12 * n_caution),
            "traction": F.when(no_track, 45).otherwise(clamp(traction)).cast("int"),
            "regulatory_ease": clamp(90 - 18 * n_caution - F.when(heavy, 10).otherwise(0)),
            "japan_openness": openness.cast("int"),
            "maker_size": size,
            "reachability": reach,
            "product_type": clamp(50 + 12 * n_favoured - F.when(c("_non_product"), 35).otherwise(0)),
            "japan_novelty": novelty.cast("int"),
            "fit_confidence": clamp(
                30
                + F.when(known_track, 25).otherwise(0)
                + checked_points
                + F.when(long_text, 15).otherwise(0)
                + F.when(maker != "", 5).otherwise(0)
            ),
            "missing": codes(
                ("funding_traction", no_track),
                (
                    "japan_sales_check",
                    c("japan_state").isin("not_checked", "queued", "running", "failed")
                    | F.coalesce(c("japan_result") == "inconclusive", F.lit(False)),
                ),
                ("contact", ~truthy(c("has_contact")) & ~truthy(c("has_official_site"))),
                ("description", ~long_text),
            ),
            "high_categories": c("_high"),
            "caution_categories": c("_caution"),
        }
    )
    scored = subs.withColumns(
        {
            "japan_market_fit": clamp(0.40 * c("category_appeal") + 0.35 * c("traction") + 0.25 * c("regulatory_ease")),
            "exclusivity": clamp(0.40 * c("japan_openness") + 0.35 * c("maker_size") + 0.25 * c("reachability")),
            "makuake_fit": clamp(0.40 * c("product_type") + 0.30 * c("traction") + 0.30 * c("japan_novelty")),
        }
    )
    overall = clamp(0.40 * c("exclusivity") + 0.35 * c("japan_market_fit") + 0.25 * c("makuake_fit"))
    return scored.withColumn("overall", overall).drop(
        "_text", "_rate", "_high", "_caution", "_maker", "_non_product"
    )


# --- outreach priority --------------------------------------------------------------------

def outreach_priority(*, japan_market_fit, exclusivity, makuake_fit, has_email, has_maker, is_new) -> Column:
    unit = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)), F.lit(100))
    return clamp(
        0.30 * unit(japan_market_fit)
        + 0.30 * unit(exclusivity)
        + 0.20 * unit(makuake_fit)
        + F.when(has_email, 10).otherwise(0)
        + F.when(has_maker, 5).otherwise(0)
        + F.when(is_new, 5).otherwise(0)
    )


# --- executive summary ------------------------------------------------------------------

def executive_score(s: dict[str, Column]) -> Column:
    person = s["contact_person_priority"]
    japan = (
        F.when(s["has_distributor"], -25).when(s["sold_in_japan"], -15).when(s["no_japan_presence"], 18).otherwise(0)
    )
    contact = (
        F.when(s["has_email"], 12).otherwise(0)
        + F.when(s["has_form"], 8).otherwise(0)
        + F.when(s["has_instagram"] | s["has_linkedin"], 6).otherwise(0)
        + F.coalesce((s["contactability_score"] - 50) * 0.1, F.lit(0.0))
    )
    status = s["sales_status"]
    similarity = s["similarity_top"]
    score = (
        F.lit(50.0)
        + F.coalesce((s["latest_score"] - 50) * 0.5, F.lit(0.0))
        + F.when(s["japan_checked"], japan).otherwise(0)
        + F.when(s["contact_checked"], contact).otherwise(-5)
        + F.when(person >= 85, 10).when(person >= 70, 5).when(person <= 40, -10).otherwise(0)
        + F.when(s["research_japan_fit"], 4).otherwise(0)
        + F.when(similarity >= 60, 8).when(similarity >= 30, 4).otherwise(0)
        + F.when(status.isin(*vocab.DONE_STATUSES), -45)
        .when(status == "negotiating", -25)
        .when(status.isin("awaiting_reply", "replied"), -22)
        .when(status == "contacted", -15)
        .when(status.isin(*vocab.READY_STATUSES), 5)
        .otherwise(0)
    )
    return clamp(score)


def executive_labels(s: dict[str, Column], score: Column) -> dict[str, Column]:
    """Labels of the summary as codes."""
    similarity = s["similarity_top"]
    parts = (
        F.coalesce(s["latest_score"] * 0.4, F.lit(0.0))
        + F.coalesce(F.least(F.lit(30.0), similarity * 0.3), F.lit(0.0))
        + F.when(s["research_japan_fit"], 10.0).otherwise(0.0)
    )
    nothing = s["latest_score"].isNull() & similarity.isNull() & ~s["research_japan_fit"]
    fit = F.when(nothing, "to_confirm").otherwise(
        numbers.ladder(parts, [(60, "high"), (38, "medium"), (18, "low")], "to_confirm")
    )
    found = codes(
        ("email", s["has_email"]),
        ("contact_form", s["has_form"]),
        ("instagram", s["has_instagram"]),
        ("linkedin", s["has_linkedin"]),
        ("facebook", s["has_facebook"]),
    )
    any_contact = F.size(found) > 0
    contact_status = (
        F.when(~s["contact_checked"], "not_searched").when(~any_contact, "none_found").otherwise(F.array_join(found, "+"))
    )
    japan_status = (
        F.when(~s["japan_checked"], "not_checked")
        .when(s["has_distributor"], "distributor")
        .when(s["sold_in_japan"], "sold")
        .when(s["no_japan_presence"], "unsold")
        .otherwise("partly_known")
    )
    normalised = map_lookup(s["contact_recommended_channel"], vocab.CHANNEL_NORMALISE)
    channel = F.coalesce(normalised, F.get(found, 0), F.lit("manual_search"))
    target = (
        F.when(s["has_distributor"], "no")
        .when(s["sold_in_japan"] & (score < 45), "no")
        .when(score >= 60, "yes")
        .when(score <= 30, "no")
        .otherwise("to_confirm")
    )
    engaged = truthy(s["sales_status"].isin(*vocab.ENGAGED_STATUSES))
    action = (
        F.when(s["has_distributor"], "probably_not_a_target")
        .when(engaged, "later")
        .when(~s["japan_checked"], "check_japan")
        .when(~any_contact, "find_contact")
        .when(target == "no", "probably_not_a_target")
        .otherwise("sell_now")
    )
    ready = truthy(s["sales_status"].isin(*vocab.READY_STATUSES))
    strong = codes(
        ("unsold_in_japan", s["japan_checked"] & s["no_japan_presence"]),
        (
            "contact_found",
            s["japan_checked"] & ~s["has_distributor"]
            & (s["has_email"] | s["has_form"] | s["has_instagram"] | s["has_linkedin"]),
        ),
        ("person_found", truthy(s["contact_person_priority"] >= 70)),
        ("high_score", truthy(s["latest_score"] >= 70)),
        ("similar_success", truthy(similarity >= 50)),
        ("market_fit", fit.isin("high", "medium")),
    )
    # the last two hints only fill a list that is still short
    strong = F.when(ready & (F.size(F.slice(strong, 1, 5)) < 5), F.array_append(strong, F.lit("not_contacted"))).otherwise(strong)
    reasons = F.slice(F.when(F.size(strong) < 3, F.array_append(strong, F.lit("worth_a_look"))).otherwise(strong), 1, 5)
    warn = codes(
        ("distributor_exists", s["has_distributor"]),
        ("already_sold", s["sold_in_japan"]),
        ("japan_not_checked", ~s["japan_checked"]),
        ("no_official_email", s["contact_checked"] & ~s["has_email"]),
        ("contact_not_searched", ~s["contact_checked"]),
        ("already_engaged", engaged),
    )
    cautions = F.slice(F.when(F.size(warn) == 0, F.array(F.lit("check_regulations"))).otherwise(warn), 1, 3)
    return {
        "market_fit_label": fit,
        "contact_status": contact_status,
        "japan_sales_status": japan_status,
        "recommended_channel": channel,
        "sales_target": target,
        "recommended_action": action,
        "reasons": reasons,
        "cautions": cautions,
    }


# --- decisions ---------------------------------------------------------------------------

def workflow_decision(s: dict[str, Column], status: Column, days: Column) -> tuple[Column, Column]:
    """Decision of the card and its urgency. ``status`` is already normalised."""
    score = s["latest_score"]
    contact = s["has_email"] | s["has_form"] | s["has_instagram"] | s["has_linkedin"] | s["has_facebook"]
    decision = (
        F.when(status.isin(*vocab.DONE_STATUSES), "closed")
        .when(status.isin("negotiating", "replied"), "needs_negotiation")
        .when(status.isin(*vocab.FOLLOWUP_STATUSES), F.when(days >= 3, "needs_followup").otherwise("waiting"))
        .when(s["has_distributor"] | s["sold_in_japan"], "drop")
        .when(
            contact,
            F.when(score >= 60, "sell_now")
            .when(~s["email_done"], "needs_email")
            .when(~s["research_done"], "needs_research")
            .otherwise("sell_now"),
        )
        .when(score.isNull() | ~s["has_official_site"], "data_insufficient")
        .otherwise("needs_contact")
    )
    weight = map_lookup(decision, vocab.DECISION_WEIGHTS)
    urgency = (
        F.coalesce(score, F.lit(40))
        + weight
        + F.when((decision == "needs_followup") & days.isNotNull(), F.least(F.lit(20), days)).otherwise(0)
    )
    return decision, urgency.cast("int")


def combined_decision(
    base: Column, *, japan_market_fit, exclusivity, makuake_fit, overall, confidence, has_contact
) -> dict[str, Column]:
    """Fit scores over the workflow decision; engaged states are kept."""
    kept = base.isin("closed", "drop", "waiting", "needs_followup", "needs_negotiation")
    decision = (
        F.when(kept, base)
        .when((overall < 35) & (confidence >= 50), "deprioritize")
        .when(has_contact & (exclusivity >= 60) & (japan_market_fit >= 55), "sell_now_exclusive")
        .when(~has_contact & (overall >= 55), "needs_contact")
        .otherwise(base)
    )
    priority = clamp(
        overall + F.when(has_contact, 8).otherwise(0) - F.when(base.isin("drop", "closed"), 25).otherwise(0)
    )
    tags = codes(
        ("exclusive_chance", exclusivity >= 67),
        ("japan_fit", japan_market_fit >= 67),
        ("makuake_relaunch", makuake_fit >= 67),
        ("thin_data", confidence < 40),
    )
    return {
        "decision": decision,
        "priority_score": priority,
        "priority_label": numbers.priority_label(priority),
        "tags": tags,
    }


def assessment_state(japan_state, confidence, assessed_at, japan_checked_at, provisional, has_assessment) -> Column:
    conf = F.coalesce(confidence, F.lit(0))
    return (
        F.when(~has_assessment, "not_evaluated")
        .when(japan_state.isin("queued", "running"), "checking_japan")
        .when(japan_checked_at > assessed_at, "recompute_pending")
        .when(truthy(provisional), "provisional")
        .when((japan_state == "failed") & (conf < 50), "failed")
        .when(conf < 40, "data_insufficient")
        .otherwise("evaluated")
    )


def visibility_reason(decision, state, has_contact) -> Column:
    return (
        F.when(decision.isin("closed", "drop"), "not_sales_target")
        .when(state == "not_evaluated", "not_evaluated")
        .when(state == "data_insufficient", "data_insufficient")
        .when(state == "checking_japan", "japan_not_checked")
        .when(decision.isin("sell_now_exclusive", "sell_now", "needs_email"), "actionable_today")
        .when((decision == "needs_contact") | ~has_contact, "needs_contact")
        .when(decision == "deprioritize", "low_priority")
        .otherwise("actionable_today")
    )


def weighted_composite(axes: DataFrame, weights: DataFrame, keys, damping: float = 1.0) -> DataFrame:
    """Axis scores (``axis, score, low_confidence``) times published weights.

    The factor for a low-confidence axis is not fixed by the domain, so it is a
    parameter; 1.0 leaves the weight alone. Weights are one row per axis.
    """
    w = F.col("weight") * F.when(truthy(F.col("low_confidence")), damping).otherwise(1.0)
    return (
        axes.filter(F.col("score").isNotNull())
        .join(F.broadcast(weights), "axis")
        .groupBy(*keys)
        .agg(clamp(F.try_divide(F.sum(F.col("score") * w), F.sum(w))).alias("composite"))
    )

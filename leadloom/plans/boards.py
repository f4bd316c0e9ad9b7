"""Rankings, task lists and dashboards: compositions of signals, scores and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, numbers
from leadloom.functions.text import map_lookup
from leadloom.operators import aggregates as agg
from leadloom.operators import scores
from leadloom.operators.history import coded, decoded, last_n, latest_by_id, top_k
from leadloom.operators.joins import category_key, prepared, project_ids, reachable_ids
from leadloom.operators.projections import normalise_sales_status, target_projects
from leadloom.operators.signals import contact_flag, executive_signals, newest_contacts, present, signal_columns, some


def executive_summaries(projects: DataFrame, **sources) -> DataFrame:
    """Score and labels of every project."""
    rows = executive_signals(projects, **sources)
    s = signal_columns()
    rows = rows.withColumn("score", scores.executive_score(s))
    labels = scores.executive_labels(s, F.col("score"))
    return rows.withColumn("stars", numbers.executive_stars(F.col("score"))).withColumns(labels)


def ranking(
    projects: DataFrame,
    *,
    limit: int = 20,
    site: str | None = None,
    unsold_only: bool = False,
    contact_only: bool = False,
    status_filter: str = "not_started",
    sort: str = "score",
    **sources,
) -> DataFrame:
    """Ranked projects. Every candidate is scored before the cut, so no project with
    a high summary score can be lost."""
    rows = target_projects(projects)
    if site:
        rows = rows.filter(F.col("source_site") == site)
    statuses = vocab.RANKING_STATUS_FILTERS.get(status_filter, vocab.READY_STATUSES)
    if statuses is not None:
        rows = rows.filter(F.col("sales_status").isin(*statuses))
    if contact_only:
        rows = rows.join(reachable_ids(sources["contacts"]), "id", "left_semi")
    summary = executive_summaries(rows, **sources)
    unsold = F.col("japan_sales_status") == "unsold"
    if unsold_only:
        summary = summary.filter(unsold)
    score, ai = F.col("score").desc(), F.coalesce(F.col("latest_score"), F.lit(-1)).desc()
    has_channel = F.col("recommended_channel").isin(*vocab.CONTACT_CHANNELS)
    order = {
        "created_at": [F.col("created_at").desc()],
        "latest_score": [ai, score],
        "contact": [has_channel.desc(), score],
        "unsold": [unsold.desc(), score],
    }.get(sort, [score, ai])
    return top_k(summary, [*order, F.col("id").asc()], limit)


def today_projects(projects, researches, contacts, drafts, limit: int = 10) -> DataFrame:
    """Prepared and not yet contacted, best priority first."""
    rows = prepared(
        target_projects(projects).filter(F.col("sales_status").isin(*vocab.READY_STATUSES)),
        researches, contacts, drafts,
    )
    yes = F.lit(True)
    common = dict(
        latest_score=F.col("latest_score"), research_done=yes, contact_available=yes, email_done=yes,
        raised=F.col("raised_amount"), goal=F.col("goal_amount"), sales_status=F.col("sales_status"),
    )
    rows = rows.withColumn("priority_score", scores.sales_priority_score(**common, backers=F.col("backers_count")))
    rows = rows.withColumns(
        {
            "stars": numbers.workflow_stars(F.col("priority_score")),
            "reasons": scores.sales_priority_reasons(**common),
        }
    )
    order = [F.col("priority_score").desc(), F.col("latest_score").desc_nulls_last(), F.col("id").asc()]
    return top_k(rows, order, limit)


def today_tasks(
    projects: DataFrame,
    *,
    contacts: DataFrame,
    drafts: DataFrame,
    assessments: DataFrame,
    activities: DataFrame,
    success_cases: DataFrame,
    as_of,
    per_group: int = 5,
) -> DataFrame:
    """Seven task groups, at most ``per_group`` rows each. A not-contacted project is
    listed under ``to_contact`` and may also be under one of the two ``needs_`` groups."""
    working = vocab.READY_STATUSES + vocab.FOLLOWUP_STATUSES + ("replied", "negotiating")
    rows = target_projects(projects).filter(F.col("sales_status").isin(*working))
    flags = (
        reachable_ids(contacts).select("id", F.lit(True).alias("has_contact"), F.lit(False).alias("has_email"))
        .unionByName(project_ids(drafts).select("id", F.lit(False).alias("has_contact"), F.lit(True).alias("has_email")))
        .groupBy("id").agg(F.bool_or("has_contact").alias("has_contact"), F.bool_or("has_email").alias("has_email"))
    )
    newest = latest_by_id(assessments, columns=["overall_priority_score"]).select(
        F.col("project_id").alias("id"), F.lit(True).alias("evaluated"), F.col("overall_priority_score").alias("overall")
    )
    outreach = agg.last_outreach(activities, drafts).withColumnRenamed("project_id", "id")
    categories = (
        success_cases.select(category_key(F.col("category"), True).alias("category_key"))
        .filter(F.col("category_key").isNotNull()).distinct().withColumn("similar", F.lit(True))
    )
    rows = (
        rows.join(flags, "id", "left").join(newest, "id", "left").join(outreach, "id", "left")
        .withColumn("category_key", F.lower(F.trim(F.coalesce(F.col("category"), F.lit("")))))
        .join(categories, "category_key", "left")
        .fillna(False, ["has_contact", "has_email", "evaluated", "similar"])
    )
    status = F.col("sales_status")
    waiting = status.isin(*vocab.FOLLOWUP_STATUSES)
    known = F.greatest(F.coalesce(F.col("latest_score"), F.lit(0)), F.coalesce(F.col("overall"), F.lit(0)))
    effective = F.when(F.coalesce(F.col("latest_score"), F.col("overall")).isNotNull(), known)
    days = F.when(waiting, dates.days_since(as_of, F.coalesce(F.col("last_outreach_at"), F.col("updated_at"))))
    rows = rows.withColumns(
        {
            "priority_score": scores.sales_priority_score(
                latest_score=effective, research_done=F.lit(False), contact_available=F.col("has_contact"),
                email_done=F.col("has_email"), raised=F.col("raised_amount"), goal=F.col("goal_amount"),
                backers=F.col("backers_count"), sales_status=status,
            ),
            "days": days,
        }
    )
    ready = status.isin(*vocab.READY_STATUSES)
    no_way = ~(F.col("has_contact") | F.col("has_email"))
    groups = F.array_compact(
        F.array(
            F.when(ready, F.lit("to_contact")),
            F.when(ready & ~F.col("evaluated"), F.lit("needs_evaluation")),
            F.when(ready & F.col("evaluated") & no_way, F.lit("needs_contact")),
            F.when(waiting & (F.col("days") >= 3), F.lit("followup")),
            F.when(waiting & (F.col("days").isNull() | (F.col("days") < 3)), F.lit("idle")),
            F.when(status == "replied", F.lit("replied")),
            F.when(status == "negotiating", F.lit("negotiating")),
        )
    )
    rows = rows.withColumn("task_group", F.explode(groups))
    group = F.col("task_group")
    rows = rows.withColumn("follow_up_level", F.when(group == "followup", dates.followup_level(F.col("days"))))
    rank_level = dates.followup_rank(F.col("follow_up_level"))
    zero = F.lit(0)
    first = F.when(group == "followup", rank_level).when(group == "needs_contact", F.coalesce(F.col("overall"), zero)).when(group == "idle", zero).otherwise(F.col("priority_score"))
    second = F.when(group == "followup", F.coalesce(F.col("days"), zero)).when(group == "needs_contact", F.col("priority_score")).otherwise(zero)
    # rows that tie keep the listing order: AI score, then recency, then id
    order = [first.desc(), second.desc(), F.col("latest_score").desc_nulls_last(), F.col("updated_at").desc(), F.col("id").asc()]
    best = last_n(rows, "task_group", order, per_group, rank="position")
    visibility = (
        F.when(group.isin("followup", "replied", "negotiating", "idle"), "actionable_today")
        .when(~F.col("evaluated"), "not_evaluated").when(no_way, "needs_contact").otherwise("actionable_today")
    )
    reasons = scores.task_reasons(
        has_contact=F.col("has_contact"), has_email=F.col("has_email"), availability=F.col("latest_availability"),
        raised=F.col("raised_amount"), goal=F.col("goal_amount"), similar=F.col("similar"), days=F.col("days"), group=group,
    )
    return best.select(
        "task_group", "position", F.col("id").alias("project_id"), "title", "sales_status", "priority_score",
        "overall", "evaluated", visibility.alias("visibility_reason"),
        numbers.workflow_stars(F.col("priority_score")).alias("stars"), "has_contact", "has_email", "days",
        "follow_up_level", reasons.alias("reasons"),
    )


def outreach_priorities(
    projects: DataFrame, *, contacts: DataFrame, assessments: DataFrame, outreach: DataFrame, limit: int | None = 20
) -> DataFrame:
    """Researched and open projects by outreach priority, with the next action."""
    cd = newest_contacts(contacts, by_id=True).withColumnRenamed("project_id", "id")
    fit = latest_by_id(assessments, columns=["japan_market_fit", "exclusivity", "makuake_fit"]).withColumnRenamed("project_id", "id")
    sent = latest_by_id(outreach, columns=["generated_at", "outreach_status"]).withColumnRenamed("project_id", "id")
    status = F.col("sales_status")
    rows = (
        target_projects(projects).filter(~status.isin(*vocab.DONE_STATUSES))
        .join(cd.filter(F.col("contact_status_raw") == "completed"), "id")
        .join(fit.withColumn("evaluated", F.lit(True)), "id", "left").join(sent, "id", "left").fillna(False, ["evaluated"])
    )
    has_email = present("primary_email") | some("discovered_emails")
    has_channel = has_email | present("primary_contact_form_url") | some("discovered_forms")
    rows = rows.withColumns(
        {
            "score": scores.outreach_priority(
                japan_market_fit=F.col("japan_market_fit"), exclusivity=F.col("exclusivity"), makuake_fit=F.col("makuake_fit"),
                has_email=has_email, has_maker=F.coalesce(F.col("maker_name") != "", F.lit(False)), is_new=status == "not_started",
            ),
            "contact_ready": has_channel,
            "recommended_action": F.when(F.col("generated_at").isNotNull(), "open_draft").when(has_channel, "generate_email").otherwise("find_contact"),
            "recommended_language": F.coalesce(map_lookup(F.col("source_site"), vocab.SITE_LANGUAGE), F.lit("en")),
        }
    )
    order = [F.col("score").desc(), F.col("latest_score").desc_nulls_last(), F.col("updated_at").desc(), F.col("id").asc()]
    return rows if limit is None else top_k(rows, order, limit)


# --- decision boards -------------------------------------------------------------------

def workflow_cards(projects: DataFrame, *, drafts: DataFrame, activities: DataFrame, as_of, **sources) -> DataFrame:
    """Decision and urgency of every live target project."""
    rows = executive_signals(target_projects(projects), **sources)
    drafted = project_ids(drafts).withColumn("email_done", F.lit(True))
    outreach = agg.last_outreach(activities, drafts).withColumnRenamed("project_id", "id")
    rows = rows.join(drafted, "id", "left").join(outreach, "id", "left").fillna(False, ["email_done"])
    days = dates.days_since(as_of, F.col("last_outreach_at"))
    rows = rows.withColumn("days", F.when(F.col("last_outreach_at").isNotNull(), days))
    s = signal_columns(("email_done",))
    decision, urgency = scores.workflow_decision(s, normalise_sales_status(F.col("sales_status")), F.col("days"))
    return rows.withColumns({"decision": decision, "urgency": urgency, "score": scores.executive_score(s)})


BUCKETS = ("sell_now", "needs_contact", "needs_email", "needs_followup", "drop", "data_insufficient")


def workflow_buckets(cards: DataFrame, per_bucket: int = 5) -> DataFrame:
    order = [F.col("urgency").desc(), F.col("latest_score").desc_nulls_last(), F.col("updated_at").desc(), F.col("id").asc()]
    return last_n(cards.filter(F.col("decision").isin(*BUCKETS)), "decision", order, per_bucket, rank="position")


def top_action(cards: DataFrame) -> DataFrame:
    order = [F.col("urgency").desc(), F.col("latest_score").desc_nulls_last(), F.col("updated_at").desc(), F.col("id").asc()]
    return cards.filter(~F.col("decision").isin("closed", "drop", "waiting")).orderBy(*order).limit(1)


def combined_cards(
    projects: DataFrame, *, assessments: DataFrame, jobs: DataFrame, japan_checks: DataFrame, contacts: DataFrame
) -> DataFrame:
    """Stored assessments only: nothing is scored here, and a project without an
    assessment keeps NULL scores."""
    fit = latest_by_id(
        assessments,
        columns=["japan_market_fit", "exclusivity", "makuake_fit", "overall_priority_score", "confidence", "provisional", F.col("created_at").alias("assessed_at")],
    ).withColumn("saved", F.lit(True))
    raw, open_states = F.col("status"), ("queued", "running")
    job = latest_by_id(
        jobs, where=F.col("job_type") == "japan_sales_check", columns=[raw.alias("job_status"), coded(raw, open_states).alias("job_code")]
    )
    facts, check_states = agg.japan_facts(F.col("channels")), ("failed", "pending", "completed")
    known = F.when(raw.isin("failed", "completed"), raw).when(raw.isNotNull(), "pending")  # any other one is under way
    check = latest_by_id(
        japan_checks,
        columns=["channels", raw.alias("check_status"), F.col("created_at").alias("checked_at"), coded(known, check_states).alias("check_code"), *[c.alias(n) for n, c in facts.items()]],
    )
    cd = newest_contacts(contacts, by_id=True, flags={"has_contact": contact_flag()})
    rows = target_projects(projects)
    for part in (fit, job, check, cd):
        rows = rows.join(part.withColumnRenamed("project_id", "id"), "id", "left")
    japan = agg.interpret_japan(
        decoded(F.col("check_code"), check_states), F.col("channels"), decoded(F.col("job_code"), open_states), F.col("checked_at"), {n: F.col(n) for n in facts}
    )
    rows = rows.fillna(False, ["saved", "has_contact"]).withColumns(japan).drop("job_code", "check_code", *facts)
    saved, overall, confidence = F.col("saved"), F.coalesce(F.col("overall_priority_score"), F.lit(0)), F.coalesce(F.col("confidence"), F.lit(0))
    base = F.coalesce(map_lookup(F.col("sales_status"), vocab.STATUS_BASE_DECISION), F.when(F.col("has_contact"), "needs_email").otherwise("needs_contact"))
    combined = scores.combined_decision(
        base, japan_market_fit=F.col("japan_market_fit"), exclusivity=F.col("exclusivity"), makuake_fit=F.col("makuake_fit"),
        overall=overall, confidence=confidence, has_contact=F.col("has_contact"),
    )
    state = scores.assessment_state(F.col("japan_state"), F.col("confidence"), F.col("assessed_at"), F.col("japan_checked_at"), F.col("provisional"), saved)
    rows = rows.withColumns(
        {
            "base_decision": F.when(saved, base).otherwise("not_evaluated"),
            "decision": F.when(saved, combined["decision"]).otherwise("not_evaluated"),
            "priority_score": F.when(saved, combined["priority_score"]),
            "priority_label": F.when(saved, combined["priority_label"]).otherwise("unrated"),
            "tags": F.when(saved, combined["tags"]).otherwise(F.array(F.lit("not_evaluated"))),
            "assessment_state": state,
        }
    )
    return rows.withColumns(
        {
            "priority_grade": numbers.grade(F.col("priority_score")),
            "decision_changed": F.col("base_decision") != F.col("decision"),
            "visibility_reason": scores.visibility_reason(F.col("decision"), F.col("assessment_state"), F.col("has_contact")),
        }
    )


COMBINED_BUCKETS = {
    "sell_now": ("sell_now_exclusive", "sell_now"),
    "needs_contact": ("needs_contact",),
    "needs_email": ("needs_email",),
    "deprioritize": ("deprioritize", "drop"),
    "data_insufficient": ("data_insufficient",),
    "not_evaluated": ("not_evaluated",),
}


def _card_order() -> list[Column]:
    return [F.coalesce(F.col("priority_score"), F.lit(-1)).desc(), F.col("latest_score").desc_nulls_last(), F.col("updated_at").desc(), F.col("id").asc()]


def combined_buckets(cards: DataFrame, per_bucket: int = 5) -> DataFrame:
    bucket = map_lookup(F.col("decision"), {d: b for b, ds in COMBINED_BUCKETS.items() for d in ds})
    return last_n(cards.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()), "bucket", _card_order(), per_bucket, rank="position")


def combined_ranking(cards: DataFrame, limit: int | None = 5) -> DataFrame:
    return cards.orderBy(*_card_order()) if limit is None else top_k(cards, _card_order(), limit)

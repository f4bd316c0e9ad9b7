"""Wide signals rows: one row per project, every input a rule needs as a column.

Each history table is reduced to its newest row per project first, then the
reduced tables are left-joined on the project id, so all joins share one key. What
the rules need of texts and channel lists is found before the reduction, as flags,
numbers and codes: the texts themselves are then carried only for those who read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import urls
from leadloom.functions.text import any_of
from leadloom.operators import aggregates as agg
from leadloom.operators.history import both, coded, decoded, latest_by_id, latest_by_time
from leadloom.operators.joins import project_ids, same_category_exists

CONTACT_COLUMNS = (
    "primary_email", "primary_contact_form_url", "instagram_url", "linkedin_url", "facebook_url",
    "official_site_url", "contactability_score", "recommended_channel", "discovered_emails",
    "discovered_forms",
)


def present(name: str):
    return F.coalesce(F.col(name) != "", F.lit(False))


def some(name: str):
    return F.coalesce(F.size(F.col(name)) > 0, F.lit(False))


def newest_contacts(contacts: DataFrame, by_id: bool = False, flags=None) -> DataFrame:
    """Newest contact row per project; ``flags`` are columns found on every row before."""
    pick = latest_by_id if by_id else latest_by_time
    columns = [c for c in CONTACT_COLUMNS if c in contacts.columns]
    if "status" in contacts.columns:
        columns.append("status")
    columns += [c.alias(n) for n, c in (flags or {}).items()]
    return pick(contacts, columns=columns).withColumnRenamed("status", "contact_status_raw")


def contact_flag():
    """Some address or form, stored as the main one or in the lists."""
    return present("primary_email") | some("discovered_emails") | present("primary_contact_form_url") | some("discovered_forms")


def newest_completed_check(checks: DataFrame, flags=None) -> DataFrame:
    return latest_by_time(
        checks,
        where=F.col("status") == "completed",
        columns=["channels", "sales_value_stars", F.col("created_at").alias("checked_at"), F.col("status").alias("check_status"),
                 *[c.alias(n) for n, c in (flags or {}).items()]],
    )


def executive_signals(
    projects: DataFrame,
    *,
    contacts: DataFrame,
    japan_checks: DataFrame,
    researches: DataFrame,
    people: DataFrame,
    success_cases: DataFrame,
) -> DataFrame:
    """Inputs of the executive score; all booleans are non-NULL."""
    channels = list(vocab.CHANNEL_NORMALISE)
    given = {
        "has_email": present("primary_email"),
        "has_form": present("primary_contact_form_url"),
        "has_instagram": present("instagram_url"),
        "has_linkedin": present("linkedin_url"),
        "has_facebook": present("facebook_url"),
        "has_official_site": urls.official_site_or_none(F.col("official_site_url")).isNotNull(),
    }
    cd = newest_contacts(contacts, flags={**given, "channel_code": coded(F.col("recommended_channel"), channels)}).withColumn("contact_checked", F.lit(True))
    flags = agg.presence_flags(F.col("channels"))
    check = newest_completed_check(japan_checks, flags).select("project_id", F.lit(True).alias("japan_checked"), *flags)
    research = latest_by_time(
        researches, where=F.col("research_status") == "completed", columns=[present("japan_market_fit").alias("research_japan_fit")]
    ).withColumn("research_done", F.lit(True))
    person = top_person(people).select("project_id", F.col("priority").alias("contact_person_priority"))
    rows = projects
    for part in (cd, check, research, person):
        rows = rows.join(part.withColumnRenamed("project_id", "id"), "id", "left")
    rows = same_category_exists(rows, success_cases)
    return rows.withColumns(
        {
            "similarity_top": F.when(F.col("similar_category"), 70),
            "contact_recommended_channel": decoded(F.col("channel_code"), channels),  # NULL for one that no rule knows
        }
    ).drop("channel_code").fillna(
        False,
        [*given,
         "contact_checked", "japan_checked", "has_distributor", "sold_in_japan", "no_japan_presence",
         "research_done", "research_japan_fit"],
    )


SIGNAL_NAMES = (
    "latest_score", "sales_status", "contact_checked", "japan_checked", "has_distributor", "sold_in_japan",
    "no_japan_presence", "research_done", "research_japan_fit", "contact_person_priority", "has_email",
    "has_form", "has_instagram", "has_linkedin", "has_facebook", "has_official_site", "similarity_top",
    "contactability_score", "contact_recommended_channel",
)


def signal_columns(extra=()) -> dict:
    return {n: F.col(n) for n in SIGNAL_NAMES + tuple(extra)}


def top_person(people: DataFrame) -> DataFrame:
    """Best contact person per project: priority, then confidence, then oldest id."""
    low = F.lit(-1)
    p, c = F.coalesce(F.col("priority"), low), F.coalesce(F.col("confidence"), low)
    order = F.struct(p.alias("p"), c.alias("c"), (-F.col("id")).alias("i"))
    # the priority is the largest one; only among those that count as -1 does the rest of the order matter
    lowest = F.max_by("priority", F.when(p == low, both(people, c, -F.col("id"))))
    priority = F.when(F.max(p) == low, lowest).otherwise(F.max(p))
    return people.groupBy("project_id").agg(
        *[F.max_by(n, order).alias(n) for n in ("id", "name", "title")],
        priority.alias("priority"),
        F.max_by("confidence", order).alias("confidence"),
    )


def fit_signals(
    projects: DataFrame, *, contacts: DataFrame, japan_checks: DataFrame, jobs: DataFrame | None = None
) -> DataFrame:
    """Inputs of the fit assessment."""
    listed = F.exists(
        F.col("channels"),
        lambda c: F.lower(c["status"]).isin("found", "limited")
        & (F.contains(F.lower(c["channel"]), F.lit("makuake")) | F.contains(F.lower(c["channel"]), F.lit("green"))),
    )
    facts = agg.japan_facts(F.col("channels"))
    check = newest_completed_check(japan_checks, {**facts, "on_makuake": listed}).withColumn("checked", F.lit(True))
    lists = [some(name) for name in ("discovered_emails", "discovered_forms") if name in contacts.columns]
    has_contact = any_of([present("primary_email"), present("primary_contact_form_url"), *lists])
    site = urls.official_site_or_none(F.col("official_site_url")).isNotNull()
    cd = newest_contacts(contacts, flags={"has_contact": has_contact, "has_site": site})
    rows = projects.join(check.withColumnRenamed("project_id", "id"), "id", "left").join(
        cd.withColumnRenamed("project_id", "id"), "id", "left"
    )
    job_status = None
    if jobs is not None:
        newest_job = latest_by_id(
            jobs, where=F.col("job_type") == "japan_sales_check", columns=[F.col("status").alias("japan_job_status")]
        )
        rows = rows.join(newest_job.withColumnRenamed("project_id", "id"), "id", "left")
        job_status = F.col("japan_job_status")
    # only completed checks are looked at
    status = F.when(F.col("checked").isNotNull(), "completed")
    japan = agg.interpret_japan(status, F.col("channels"), job_status, F.col("checked_at"), {n: F.col(n) for n in facts})
    has_site = F.coalesce(F.col("has_site"), F.lit(False)) | urls.official_site_or_none(F.col("maker_url")).isNotNull()
    return rows.withColumns(japan).select(
        "id",
        "title",
        F.coalesce(F.col("description_clean"), F.col("description")).alias("description"),
        "category",
        F.col("raised_amount").cast("double").alias("raised"),
        F.col("goal_amount").cast("double").alias("goal"),
        F.lit(None).cast("double").alias("rate_pct"),
        F.col("backers_count").alias("backers"),
        "maker_name",
        "source_site",
        has_site.alias("has_official_site"),
        F.coalesce(F.col("has_contact"), F.lit(False)).alias("has_contact"),
        (F.col("japan_state") == "completed").alias("japan_checked"),
        F.col("sales_value_stars").alias("japan_stars"),
        F.coalesce(F.col("japan_result") == "sold_in_japan", F.lit(False)).alias("already_in_japan"),
        F.coalesce(F.col("on_makuake"), F.lit(False)).alias("on_makuake"),
        "japan_state",
        "japan_result",
        "japan_confidence",
        "japan_checked_at",
    )


def adjust_scores(scored: DataFrame, adjusted: DataFrame, columns) -> DataFrame:
    """User hook: replace rule scores by the non-NULL columns of ``adjusted(id, …)``.

    ``adjusted`` is whatever a user's ``mapInPandas`` or join produced; a project it
    lacks keeps the rule result. Sets ``ai_adjusted``.
    """
    given = adjusted.select("id", *[F.col(c).alias("_" + c) for c in columns])
    out = scored.join(given, "id", "left")
    changed = F.coalesce(*[F.col("_" + c) for c in columns]).isNotNull()
    out = out.withColumn("ai_adjusted", changed)
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col("_" + c), F.col(c)))
    return out.drop(*["_" + c for c in columns])


__all__ = [
    "executive_signals", "fit_signals", "signal_columns", "top_person", "adjust_scores", "newest_contacts",
    "newest_completed_check", "project_ids",
]

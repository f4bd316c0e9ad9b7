"""Status machine, CRM propagation, follow-ups, workflow progress, reuse rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates
from leadloom.functions.text import any_of, codes, map_lookup
from leadloom.operators.history import last_n, latest_by_time
from leadloom.operators.projections import normalise_sales_status

MAX_FOLLOWUPS = 2


def can_transition(from_status: Column, to_status: Column) -> Column:
    """Same state, or a pair of the transition table; aliases are resolved first."""
    src, dst = normalise_sales_status(from_status), normalise_sales_status(to_status)
    allowed = any_of([(src == s) & dst.isin(*targets) for s, targets in vocab.STATUS_TRANSITIONS.items()])
    return (src == dst) | allowed


def bulk_status_update(projects: DataFrame, chosen: DataFrame, target: str) -> DataFrame:
    """Outcome of applying one target status: ``updated``, ``skipped`` or ``unchanged``.

    ``updated`` rows are the status events; unknown ids drop out of the join.
    """
    rows = projects.join(chosen.select("id").distinct(), "id", "left_semi")
    src, dst = normalise_sales_status(F.col("sales_status")), normalise_sales_status(F.lit(target))
    result = F.when(src == dst, "unchanged").when(can_transition(src, dst), "updated").otherwise("skipped")
    return rows.select("id", src.alias("from_status"), dst.alias("to_status"), result.alias("result"))


def sync_forward(status: Column, target: str, only_from) -> Column:
    """Advance only from the given states; anything later stays."""
    cur = normalise_sales_status(status)
    return F.when(cur.isin(*only_from), normalise_sales_status(F.lit(target))).otherwise(cur)


def crm_effects(events: DataFrame) -> DataFrame:
    """Activity kind and maker status of every status event; early states have none."""
    to = normalise_sales_status(F.col("to_status"))
    kind = map_lookup(to, {k: v[0] for k, v in vocab.CRM_PROPAGATION.items()})
    maker = map_lookup(to, {k: v[1] for k, v in vocab.CRM_PROPAGATION.items()})
    return events.withColumns({"activity_kind": kind, "maker_status": maker}).filter(F.col("activity_kind").isNotNull())


def followup_eligible(outreach_status: Column, followup_count: Column) -> Column:
    return (outreach_status == "sent") & (F.coalesce(followup_count, F.lit(0)) < MAX_FOLLOWUPS)


def execution_tasks(outreach: DataFrame, projects: DataFrame, as_of, limit: int = 50) -> DataFrame:
    """Follow-up buckets after sending; a row may be in two. Archived projects drop out."""
    now = dates.timestamp_lit(as_of)
    today = F.date_trunc("day", now)
    due, status = F.col("followup_due_at"), F.col("outreach_status")
    sent = F.coalesce(status == "sent", F.lit(False))
    ready = F.coalesce((F.coalesce(F.col("followup_count"), F.lit(0)) < MAX_FOLLOWUPS) & (due <= now), F.lit(False))
    buckets = F.array_compact(
        F.array(
            F.when(status.isin("replied", "negotiating"), F.lit("replied")),
            F.when(sent & ready, F.lit("follow_today")),
            F.when(sent & ready & (due < today), F.lit("overdue")),
            F.when(sent & ~ready, F.lit("awaiting_reply")),
        )
    )
    live = projects.filter(F.col("archived_at").isNull()).select(F.col("id").alias("project_id"))
    overdue = F.greatest(F.datediff(today.cast("date"), due.cast("date")), F.lit(0))
    rows = (
        outreach.filter(F.col("sent_at").isNotNull())
        .join(live, "project_id", "left_semi")
        .withColumn("bucket", F.explode(buckets))
        .withColumn("days_overdue", overdue)
        .withColumn("followups_remaining", F.greatest(F.lit(MAX_FOLLOWUPS) - F.coalesce(F.col("followup_count"), F.lit(0)), F.lit(0)))
    )
    return last_n(rows, "bucket", [due.asc_nulls_last(), F.col("id").asc()], limit, rank="position")


CHANNEL_COLUMNS = {
    "contact_form": "primary_contact_form_url",
    "instagram": "instagram_url",
    "linkedin": "linkedin_url",
    "facebook": "facebook_url",
    "twitter": "twitter_url",
    "youtube": "youtube_url",
    "official_site": "official_site_url",
}
SHORT_MESSAGE_CHANNELS = ("contact_form", "instagram", "linkedin", "facebook")


def workflow_progress(flagged: DataFrame, contacts: DataFrame) -> DataFrame:
    """Step flags and open channels per project. ``flagged`` has the preparedness flags."""
    columns = [*CHANNEL_COLUMNS.values(), "primary_email", "recommended_channel"]
    cd = latest_by_time(contacts, columns=[c for c in columns if c in contacts.columns]).withColumnRenamed("project_id", "id")
    rows = flagged.join(cd, "id", "left")
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False)) if c in cd.columns else F.lit(False)
    pairs = [(k, present(c)) for k, c in CHANNEL_COLUMNS.items()] + [("gmail", present("primary_email"))]
    channels = codes(*pairs)
    recommended = F.when(F.col("recommended_channel") == "email", "gmail").otherwise(F.col("recommended_channel"))
    return rows.withColumns(
        {
            "channels": channels,
            "recommended_open": F.when(F.array_contains(channels, recommended), recommended),
            "dm_done": any_of([present(CHANNEL_COLUMNS[k]) for k in SHORT_MESSAGE_CHANNELS]),
            "ready_to_sell": F.expr("research_done AND contact_done AND email_done")
            & F.col("sales_status").isin(*vocab.READY_STATUSES),
        }
    )


def recent_result(jobs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Newest completed job per project and kind inside the reuse window."""
    since = dates.timestamp_lit(as_of) - F.make_dt_interval(hours=F.lit(hours))
    fresh = jobs.filter((F.col("status") == "completed") & (F.col("finished_at") >= since))
    return fresh.groupBy("project_id", "job_type").agg(
        F.max_by(F.col("id"), F.struct("finished_at", "id")).alias("job_id")
    )


def stale_jobs(jobs: DataFrame, as_of, stale_seconds: int = 90) -> DataFrame:
    """Running jobs whose newest sign of life is too old."""
    seen = F.coalesce(F.col("heartbeat_at"), F.col("started_at"), F.col("created_at"))
    limit = dates.timestamp_lit(as_of) - F.make_dt_interval(secs=F.lit(stale_seconds))
    return jobs.filter((F.col("status") == "running") & (seen < limit)).select(
        "id", "project_id", F.lit("timed_out").alias("status")
    )


def crawl_outcome_codes(f: dict[str, Column]) -> Column:
    """Why a finished contact search has no (better) result."""
    no_email = f["n_emails"] == 0
    return codes(
        ("provider_failed", f["provider_failed"]),
        ("no_results", f["no_results"]),
        ("official_site_not_registered", f["site_not_registered"]),
        ("crawl_blocked", f["blocked"]),
        ("email_not_public", no_email),
        ("mx_exists_no_email", no_email & f["has_mx"]),
        ("form_only", no_email & (f["n_forms"] > 0)),
        ("social_only", no_email & (f["n_forms"] == 0) & (f["n_socials"] > 0)),
        ("document_without_email", f["n_documents_read"].isNotNull() & (f["n_documents_read"] > 0) & no_email),
        ("rate_limited", f["rate_limited"]),
        ("timeout", f["timed_out"]),
        ("login_required", f["login_required"]),
    )

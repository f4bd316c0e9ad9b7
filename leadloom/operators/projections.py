"""List filters, bulk archive, facts and other row-wise views of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import dates, numbers, urls
from leadloom.functions.text import blank


def target_projects(projects: DataFrame) -> DataFrame:
    """Projects on the sites sales works on, not archived."""
    return projects.filter(
        F.col("source_site").isin(*vocab.SALES_TARGET_SITES) & F.col("archived_at").isNull()
    )


def contains_ignoring_case(column: Column, q: str) -> Column:
    return F.contains(F.lower(column), F.lit(q.lower()))


def filter_projects(
    projects: DataFrame,
    *,
    site=None,
    status=None,
    sales_status=None,
    category=None,
    q=None,
    min_score=None,
    recommendation=None,
    qualification=None,
    archived: bool = False,
) -> DataFrame:
    keep = F.col("source_site").isin(*vocab.SALES_TARGET_SITES)
    keep &= F.col("archived_at").isNotNull() if archived else F.col("archived_at").isNull()
    if site:
        keep &= F.col("source_site") == site
    if status:
        keep &= F.col("status") == status
    if sales_status == "contract_agreed":
        keep &= F.col("sales_status").isin("contract_agreed", "won")
    elif sales_status:
        keep &= F.col("sales_status") == sales_status
    if category:
        keep &= F.col("category") == category
    if q:
        keep &= contains_ignoring_case(F.col("title"), q)
    if min_score is not None:
        keep &= F.col("latest_score") >= min_score
    if recommendation:
        keep &= F.col("latest_recommendation") == recommendation
    if qualification:
        keep &= F.col("lead_qualification_decision") == qualification
    return projects.filter(keep)


def filter_success_cases(cases: DataFrame, *, platform=None, category=None, q=None) -> DataFrame:
    if platform:
        cases = cases.filter(F.col("platform") == platform)
    if category:
        cases = cases.filter(F.col("category") == category)
    if q:
        cases = cases.filter(contains_ignoring_case(F.col("title"), q))
    return cases


def filter_makers(makers: DataFrame, *, status=None, q=None) -> DataFrame:
    if status:
        makers = makers.filter(F.col("status") == status)
    if q:
        makers = makers.filter(contains_ignoring_case(F.col("name"), q))
    return makers


def filter_opportunities(opps: DataFrame, *, status=None, sales_priority=None, min_score=None) -> DataFrame:
    if status:
        opps = opps.filter(F.col("status") == status)
    if sales_priority:
        opps = opps.filter(F.col("sales_priority") == sales_priority)
    if min_score is not None:
        opps = opps.filter(F.col("sales_score") >= min_score)
    return opps


def card_filters() -> dict[str, Column]:
    """The eleven named predicates over decision cards."""
    decision, score = F.col("decision"), lambda name: F.coalesce(F.col(name), F.lit(0))
    return {
        "all": F.lit(True),
        "sell_now_exclusive": decision.isin("sell_now_exclusive", "sell_now"),
        "needs_email": decision == "needs_email",
        "needs_contact": decision == "needs_contact",
        "data_insufficient": decision == "data_insufficient",
        "deprioritize": decision == "deprioritize",
        "high_japan_fit": score("japan_market_fit") >= 65,
        "high_exclusivity": score("exclusivity") >= 65,
        "makuake_promising": score("makuake_fit") >= 65,
        "japan_not_checked": F.col("japan_state").isin("not_checked", "failed"),
        "low_confidence": score("confidence") < 40,
    }


def apply_card_filter(cards: DataFrame, name: str) -> DataFrame:
    return cards.filter(card_filters()[name])


def normalise_sales_status(status: Column) -> Column:
    s = F.coalesce(status, F.lit("not_started"))
    return F.when(s == "won", F.lit("contract_agreed")).otherwise(s)


def archive(projects: DataFrame, chosen: DataFrame, as_of, reason: str | None = None) -> DataFrame:
    """New snapshot with the chosen ids archived; unknown ids have no effect."""
    flagged = projects.join(
        chosen.select(F.col("id")).distinct().withColumn("chosen", F.lit(True)), "id", "left"
    )
    hit = F.coalesce(F.col("chosen"), F.lit(False))
    out = flagged.withColumn(
        "archived_at",
        F.when(hit & F.col("archived_at").isNull(), dates.timestamp_lit(as_of)).otherwise(F.col("archived_at")),
    )
    if reason is not None:
        out = out.withColumn(
            "archive_reason", F.when(hit, F.lit(reason)).otherwise(F.col("archive_reason"))
        )
    return out.drop("chosen")


def restore(projects: DataFrame, chosen: DataFrame) -> DataFrame:
    flagged = projects.join(
        chosen.select(F.col("id")).distinct().withColumn("chosen", F.lit(True)), "id", "left"
    )
    keep = F.col("chosen").isNull()
    return (
        flagged.withColumn("archived_at", F.when(keep, F.col("archived_at")))
        .withColumn("archive_reason", F.when(keep, F.col("archive_reason")))
        .drop("chosen")
    )


def compact_facts(projects: DataFrame, as_of) -> DataFrame:
    """The few facts shown with every ranked row; unknown stays NULL."""
    raised, goal = F.col("raised_amount"), F.col("goal_amount")
    rate = F.when(
        (raised > 0) & (goal > 0), numbers.funding_percent_rounded(raised, goal)
    )
    return projects.select(
        "id",
        "category",
        dates.campaign_state(F.col("end_date"), as_of).alias("campaign_state"),
        dates.days_remaining(F.col("end_date"), as_of).alias("days_remaining"),
        rate.alias("funding_rate"),
        "backers_count",
        raised.cast("double").alias("raised_amount"),
        "currency",
    )


def fact_rows(entities: DataFrame, id_column: str, facts: list[dict]) -> DataFrame:
    """Unpivot to one row per (entity, label). ``facts`` lists dicts with ``label``,
    ``value`` (Column) and optional ``source_kind``, ``source_url``, ``checked_at``,
    ``ai_generated``. A blank value loses its source."""

    def one(order: int, f: dict) -> Column:
        value = f["value"].cast("string")
        empty = blank(value)
        source_url = f.get("source_url", F.lit(None)).cast("string")
        checked = f.get("checked_at", F.lit(None)).cast("timestamp")
        return F.struct(
            F.lit(order).alias("position"),
            F.lit(f["label"]).alias("label"),
            F.when(~empty, value).alias("value"),
            F.when(empty, "not_acquired").otherwise("acquired").alias("status"),
            F.when(~empty, F.lit(f.get("source_kind"))).alias("source_kind"),
            F.when(~empty, source_url).alias("source_url"),
            F.when(~empty, checked).alias("checked_at"),
            (F.lit(bool(f.get("ai_generated"))) & ~empty).alias("ai_generated"),
        )

    rows = F.array(*[one(i, f) for i, f in enumerate(facts)])
    return entities.select(F.col(id_column), F.explode(rows).alias("fact")).select(id_column, "fact.*")


def project_facts(projects: DataFrame, as_of) -> DataFrame:
    """Product and campaign facts of every project in long form."""
    page = urls.campaign_url(F.col("source_url"), F.col("source_site"))
    site = urls.maker_site(F.col("maker_url"))
    checked = F.col("updated_at")

    def from_campaign(label, value):
        return {"label": label, "value": value, "source_kind": "campaign", "source_url": page, "checked_at": checked}

    money = lambda c: F.when(c.isNotNull(), F.concat_ws(" ", F.col("currency"), F.format_number(F.bround(c.cast("double"), 0), 0)))
    compact = {
        "state": dates.campaign_state(F.col("end_date"), as_of),
        "left": dates.days_remaining(F.col("end_date"), as_of),
        "rate": F.when(
            (F.col("raised_amount") > 0) & (F.col("goal_amount") > 0),
            numbers.funding_percent_rounded(F.col("raised_amount"), F.col("goal_amount")),
        ),
    }
    return fact_rows(
        projects,
        "id",
        [
            from_campaign("title", F.col("title")),
            from_campaign("campaign_page", page),
            {"label": "official_site", "value": site, "source_kind": "official_site", "source_url": site, "checked_at": checked},
            from_campaign("site", F.col("source_site")),
            from_campaign("category", F.col("category")),
            from_campaign("start_date", F.col("start_date")),
            from_campaign("end_date", F.col("end_date")),
            from_campaign("campaign_state", compact["state"]),
            from_campaign("days_remaining", compact["left"]),
            from_campaign("goal", money(F.col("goal_amount"))),
            from_campaign("raised", money(F.col("raised_amount"))),
            from_campaign("funding_rate", compact["rate"]),
            from_campaign("backers", F.col("backers_count")),
        ],
    )


def evaluation_cost(projects: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Tokens and cost of scoring every project that has no score yet.

    ``prices(model, usd_in, usd_out)`` is per million tokens; an unknown model costs 0.
    """
    tokens_in, tokens_out = vocab.EVALUATION_TOKENS
    n = projects.filter(F.col("latest_score").isNull() & F.col("archived_at").isNull()).agg(
        F.count(F.lit(1)).alias("count")
    )
    price = prices.filter(F.col("model") == model).agg(
        F.max("usd_in").alias("usd_in"), F.max("usd_out").alias("usd_out")
    )
    est_in, est_out = F.col("count") * tokens_in, F.col("count") * tokens_out
    cost = est_in / 1_000_000 * F.col("usd_in") + est_out / 1_000_000 * F.col("usd_out")
    # both sides are one-row aggregates
    return n.join(price, F.lit(True), "left").select(
        "count",
        est_in.alias("est_input_tokens"),
        est_out.alias("est_output_tokens"),
        F.bround(F.coalesce(cost, F.lit(0.0)), 6).alias("est_cost_usd"),
    )


def recipient(latest_contact: DataFrame) -> DataFrame:
    """Primary address, else the first discovered one."""
    first = F.get(F.col("discovered_emails"), 0)["email"]
    return latest_contact.select(
        "project_id", F.coalesce(F.nullif(F.col("primary_email"), F.lit("")), first).alias("recipient")
    )


# --- sort and page -------------------------------------------------------------

PROJECT_SORTS = ("created_at", "updated_at", "raised_amount", "backers_count", "end_date", "title", "latest_score")
SUCCESS_SORTS = ("created_at", "updated_at", "raised_amount", "backers_count", "end_date", "title")
MAKER_SORTS = ("updated_at", "created_at", "name", "next_action_date", "status")


def sort_and_page(
    rows: DataFrame, allowed, sort: str, order: str = "desc", page: int = 1, page_size: int = 20
) -> DataFrame:
    """One page in a whitelisted order. NULLs last either way, id breaks ties.

    The total is ``rows.count()``; it is a separate aggregate over the same filter.
    """
    column = F.col(sort if sort in allowed else allowed[0])
    key = column.asc_nulls_last() if order == "asc" else column.desc_nulls_last()
    page = max(page, 1)
    size = min(max(page_size, 1), 100)
    return rows.orderBy(key, F.col("id").asc()).offset((page - 1) * size).limit(size)


def order_opportunities(opps: DataFrame, sort: str = "score") -> list[Column]:
    """Sort keys of the opportunity list."""
    return {
        "due_date": [
            F.col("next_action_due_date").asc_nulls_last(),
            F.col("sales_score").desc(),
            F.col("id").asc(),
        ],
        "created": [F.col("created_at").desc(), F.col("id").desc()],
    }.get(sort, [F.col("sales_score").desc(), F.col("id").desc()])


def card_sort(key: str) -> list[Column]:
    return [F.coalesce(F.col(key), F.lit(0)).desc(), F.col("project_id").asc()]


def reminders(makers: DataFrame, as_of, within_days: int | None = None) -> DataFrame:
    """Makers with a next action, soonest first, overdue ones flagged."""
    today = F.to_date(dates.timestamp_lit(as_of))
    due = F.col("next_action_date")
    rows = makers.filter(due.isNotNull())
    if within_days is not None:
        rows = rows.filter(due <= F.date_add(today, within_days))
    return rows.select(
        F.col("id").alias("maker_id"),
        F.col("name").alias("maker_name"),
        "status",
        "next_action",
        "next_action_date",
        (due < today).alias("overdue"),
    ).orderBy("next_action_date", "maker_id")



"""KPI, usage, source health, Japan presence and distribution aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom import vocab
from leadloom.functions import dates, numbers
from leadloom.functions.text import any_of
from leadloom.functions.urls import lit_array
from leadloom.operators.history import last_n
from leadloom.operators.joins import preparedness
from leadloom.operators.projections import target_projects


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def sales_kpis(projects, researches, contacts, drafts) -> DataFrame:
    """One row of pipeline counts over live target projects."""
    flagged = preparedness(target_projects(projects), researches, contacts, drafts)
    s = F.col("sales_status")
    ready = s.isin(*vocab.READY_STATUSES) & F.expr("research_done AND contact_done AND email_done")
    return flagged.agg(
        count_where(ready, "ready_count"),
        count_where(ready, "today_count"),
        count_where(s == "awaiting_reply", "awaiting_reply_count"),
        count_where(s == "replied", "replied_count"),
        count_where(s == "negotiating", "negotiating_count"),
        count_where(s.isin(*vocab.SECURED_STATUSES, "won"), "won_count"),
        count_where(s.isin("contract_agreed", "won"), "contract_agreed_count"),
        count_where(s == "selling", "selling_count"),
        count_where(s == "contacted", "contacted_count"),
    )


def usage_summary(logs: DataFrame, as_of) -> DataFrame:
    """Cost, tokens and calls today, this month and in all, in one pass."""
    now = dates.timestamp_lit(as_of)
    starts = {
        "today": F.date_trunc("day", now),
        "month": F.date_trunc("month", now),
        "total": None,
    }
    measures = {"cost_usd": F.col("cost_usd").cast("decimal(18,6)"), "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "calls": F.lit(1)}
    out = []
    for period, start in starts.items():
        inside = F.lit(True) if start is None else F.col("created_at") >= start
        for name, value in measures.items():
            out.append(F.coalesce(F.sum(F.when(inside, value)), F.lit(0)).alias(f"{period}_{name}"))
    return logs.agg(*out)


def last_outreach(activities: DataFrame, drafts: DataFrame) -> DataFrame:
    """Newest activity, else newest draft; an activity wins even if it is older."""
    acts = activities.select("project_id", F.col("occurred_at").alias("activity_at"), F.lit(None).cast("timestamp").alias("draft_at"))
    mail = drafts.select("project_id", F.lit(None).cast("timestamp").alias("activity_at"), F.col("created_at").alias("draft_at"))
    return (
        acts.unionByName(mail)
        .filter(F.col("project_id").isNotNull())
        .groupBy("project_id")
        .agg(F.coalesce(F.max("activity_at"), F.max("draft_at")).alias("last_outreach_at"))
        .filter(F.col("last_outreach_at").isNotNull())
    )


def source_health(runs: DataFrame, window: int = 20, sites=vocab.MONITORED_SITES, threshold: float = 0.5) -> DataFrame:
    """Per monitored site over its newest ``window`` finished runs."""
    finished = runs.filter((F.col("status") != "running") & F.col("site").isin(*sites))
    recent = last_n(finished, "site", [F.col("started_at").desc(), F.col("id").desc()], window)
    ok = F.col("status") == "success"
    kind = F.coalesce(F.col("error_kind"), F.lit("unknown"))
    at = F.coalesce(F.col("finished_at"), F.col("started_at"))

    def newest_at(cond):  # the first hit in newest-first order, not the latest clock time
        return F.min_by(F.when(cond, at), F.when(cond, F.col("rn")))

    stats = recent.groupBy("site").agg(
        F.count(F.lit(1)).alias("total"),
        count_where(ok, "success"),
        count_where(~ok & (kind == "network"), "network_errors"),
        count_where(~ok & (kind == "structure"), "structure_errors"),
        count_where(~ok & ~kind.isin("network", "structure"), "unknown_errors"),
        count_where(~ok & F.contains(F.col("error"), F.lit("403")), "http_403_count"),
        F.min_by("status", "rn").alias("last_status"),
        F.min_by(at, F.col("rn")).alias("last_run_at"),
        newest_at(ok).alias("last_success_at"),
        newest_at(~ok).alias("last_failure_at"),
        newest_at(~ok & (kind == "structure")).alias("last_structure_error_at"),
    )
    names = runs.sparkSession.createDataFrame([(s,) for s in sites], "site string")
    counts = ["total", "success", "network_errors", "structure_errors", "unknown_errors", "http_403_count"]
    errors = F.col("network_errors") + F.col("structure_errors") + F.col("unknown_errors")
    recovered = F.coalesce(F.col("last_success_at") > F.col("last_structure_error_at"), F.lit(False))
    return (
        names.join(stats, "site", "left")
        .fillna(0, counts)
        .withColumn("success_rate", F.when(F.col("total") > 0, F.bround(F.col("success") / F.col("total"), 4)))
        .withColumn("structure_change_suspected", (F.col("structure_errors") > 0) & ~recovered)
        .withColumn("degraded", F.coalesce((errors > 0) & (F.col("success_rate") < threshold), F.lit(False)))
    )


def job_rollup(runs: DataFrame) -> DataFrame:
    stats = (
        runs.filter(F.col("job_run_id").isNotNull())
        .groupBy("job_run_id")
        .agg(count_where(F.col("status") == "success", "succeeded"), count_where(F.col("status") == "error", "failed"))
    )
    good, bad = F.col("succeeded") > 0, F.col("failed") > 0
    return stats.withColumn("job_status", F.when(good & ~bad, "success").when(good & bad, "partial").otherwise("error"))


def alerts(health: DataFrame) -> DataFrame:
    """All suspected or degraded sites, but only when some site is suspected.

    ``health`` holds one row per site, so the global window is a handful of rows.
    """
    any_suspect = F.bool_or("structure_change_suspected").over(Window.partitionBy(F.lit(1)))
    return (
        health.withColumn("any_suspect", any_suspect)
        .filter(F.col("any_suspect") & (F.col("structure_change_suspected") | F.col("degraded")))
        .select(
            "site",
            F.array_join(
                F.array_compact(
                    F.array(
                        F.when(F.col("structure_change_suspected"), F.lit("structure_change")),
                        F.when(F.col("degraded"), F.lit("low_success_rate")),
                    )
                ),
                ",",
            ).alias("issues"),
            "network_errors",
            "structure_errors",
            "unknown_errors",
            "http_403_count",
            "success_rate",
            F.col("last_failure_at").alias("last_error_at"),
            "last_structure_error_at",
        )
    )


def availability(checks: DataFrame, hits: DataFrame) -> DataFrame:
    """Verdict per check from its best search hit."""
    best = hits.groupBy("check_id").agg(
        F.max("match_score").alias("score"),
        F.array_join(F.array_sort(F.collect_set("site")), ",").alias("sites_hit"),
        F.max_by(F.col("site"), F.struct(F.col("match_score"), (-F.col("id")).alias("first"))).alias("top_site"),
    )
    score = F.coalesce(F.col("score"), F.lit(0))
    return (
        checks.join(best, checks["id"] == best["check_id"], "left")
        .withColumn("score", score)
        .withColumn("verdict", F.when(score >= 80, "sold").when(score >= 50, "possible").otherwise("not_landed"))
        .select("id", "project_id", "score", "verdict", F.coalesce("sites_hit", F.lit("")).alias("sites_hit"), "top_site")
    )


# --- Japan presence: the channels of one check are a short array -------------------

def _status(channels: Column) -> Column:
    return F.map_from_entries(
        F.transform(channels, lambda c: F.struct(c["channel"], c["status"]))
    )


def _is(channels: Column, keys, statuses) -> Column:
    return F.exists(channels, lambda c: c["channel"].isin(*keys) & c["status"].isin(*statuses))


def _how_many(channels: Column, keys, statuses) -> Column:
    return F.size(F.filter(channels, lambda c: c["channel"].isin(*keys) & c["status"].isin(*statuses)))


CHANNELS_TYPE = "array<struct<channel:string,label:string,status:string,search_url:string,note:string>>"


def _st(c: Column) -> Column:
    return F.lower(F.coalesce(c["status"], F.lit("")))


def _key(c: Column) -> Column:
    return F.lower(F.coalesce(c["channel"], F.lit("")))


def _found(channels: Column) -> Column:
    return F.filter(channels, lambda c: _st(c).isin("found", "limited"))


def presence_stars(channels: Column) -> Column:
    """5 = nothing found in Japan … 1 = widely sold."""
    shops = _how_many(channels, vocab.SHOP_CHANNELS, ("found",))
    traces = _how_many(channels, vocab.SHOP_CHANNELS, ("limited",))
    return (
        F.when(_is(channels, vocab.DISTRIBUTOR_CHANNELS, ("found",)), F.when(shops >= 2, 1).otherwise(2))
        .when(shops >= 2, 1)
        .when(shops == 1, 3)
        .when((traces >= 1) | _is(channels, vocab.DOMESTIC_CROWDFUNDING_CHANNELS, ("found",)), 4)
        .otherwise(5)
    )


def presence_flags(channels: Column) -> dict[str, Column]:
    distributor = _is(channels, vocab.DISTRIBUTOR_CHANNELS, ("found",))
    sold = _is(channels, vocab.SHOP_CHANNELS, ("found",))
    return {"has_distributor": distributor, "sold_in_japan": sold, "no_japan_presence": ~distributor & ~sold}


def japan_facts(channels: Column) -> dict[str, Column]:
    """What the state of one check needs of its channels, as flags and a number."""
    channels = F.coalesce(channels, F.array().cast(CHANNELS_TYPE))
    hit = lambda c: _st(c).isin("found", "limited")
    checked = F.size(F.filter(channels, lambda c: _st(c).isin("found", "limited", "not_found")))
    return {
        "japan_presence": F.exists(channels, lambda c: hit(c) & _key(c).isin(*vocab.PRESENCE_CHANNELS)),
        "japan_crowdfunding": F.exists(channels, lambda c: hit(c) & _key(c).isin(*vocab.DOMESTIC_CROWDFUNDING_CHANNELS)),
        "japan_not_found": (checked >= 3) & ~F.exists(channels, hit),
        "japan_share": numbers.whole(checked / F.greatest(F.size(channels), F.lit(1)) * 30),
    }


def interpret_japan(
    status: Column, channels: Column, job_status: Column | None = None, checked_at: Column | None = None,
    facts: dict[str, Column] | None = None,
) -> dict[str, Column]:
    """State, result and confidence of the newest check. ``status`` is NULL when
    there is no check; an open job hides an older result. ``facts`` are the
    ``japan_facts`` of the channels, if they are known already."""
    channels = F.coalesce(channels, F.array().cast(CHANNELS_TYPE))
    active = F.coalesce(job_status.isin("queued", "running"), F.lit(False)) if job_status is not None else F.lit(False)
    found = _found(channels)
    presence, crowdfunding, not_found, share = (facts or japan_facts(channels)).values()
    state = (
        F.when(active, job_status if job_status is not None else F.lit(None))
        .when(status.isNull(), "not_checked")
        .when(status == "failed", "failed")
        .when(status != "completed", "running")
        .otherwise("completed")
    )
    done = state == "completed"
    result = F.when(done, F.when(presence | crowdfunding, "sold_in_japan").when(not_found, "not_found_in_japan").otherwise("inconclusive"))
    confidence = F.when(
        done,
        F.when(presence, 85).when(crowdfunding, 70).when(not_found, F.least(numbers.clamp(40 + share), F.lit(65))).otherwise(25),
    ).otherwise(0)
    links = F.array_compact(
        F.transform(F.filter(channels, lambda c: _st(c).isin("found", "limited", "not_found")), lambda c: F.nullif(c["search_url"], F.lit("")))
    )
    label = lambda c: F.coalesce(F.nullif(c["label"], F.lit("")), _key(c))
    evidence = F.transform(found, lambda c: F.concat(label(c), F.lit(": "), _st(c)))
    empty = F.array().cast("array<string>")
    return {
        "japan_state": state,
        "japan_result": result,
        "japan_confidence": confidence.cast("int"),
        "japan_evidence": F.when(done, evidence).otherwise(empty),
        "japan_source_urls": F.when(done, F.array_sort(F.array_distinct(links))).otherwise(empty),
        **({"japan_checked_at": F.when(~active, checked_at)} if checked_at is not None else {}),
    }


def mean_axis_score(scores: Column) -> tuple[Column, Column]:
    """Mean of an axis map and its recommendation."""
    values = F.map_values(scores)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    mean = F.bround(F.try_divide(total, F.size(values)), 0).cast("int")
    return mean, numbers.ladder(mean, [(75, "high"), (50, "mid")], "low")


def decision_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def decision_summary(cards: DataFrame) -> DataFrame:
    """Five counts shown above the decision board."""
    return cards.agg(
        count_where(F.col("japan_state").isin("not_checked", "failed"), "japan_not_checked"),
        count_where(F.col("assessment_state") == "not_evaluated", "not_evaluated"),
        count_where(F.col("assessment_state") == "checking_japan", "checking_japan"),
        count_where(F.col("assessment_state") == "data_insufficient", "data_insufficient"),
        count_where(F.col("saved") & (F.coalesce(F.col("confidence"), F.lit(0)) < 40), "low_confidence"),
    )


# --- population audit ----------------------------------------------------------------

MEMBERSHIP_ORDER = ("archived", "v2_completed", "dummy", "no_seed", "no_campaign_url", "active_job")


def membership(flags: dict[str, Column]) -> Column:
    """First reason, in fixed order, why a project is outside the population."""
    out = None
    for name in MEMBERSHIP_ORDER:
        hit = F.coalesce(flags[name], F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise("in_population")


def audit_funnel(records: DataFrame) -> DataFrame:
    """Membership counts in order, then evidence ratios and code frequencies of the
    population, as ``(section, key, n, denominator, percent)``."""
    order = lit_array(MEMBERSHIP_ORDER + ("in_population",))
    members = (
        records.groupBy("membership").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("membership").alias("section"), F.col("membership").alias("key"), "n", F.array_position(order, F.col("membership")).cast("int").alias("position"))
    )
    population = records.filter(F.col("membership") == "in_population")
    total = population.agg(F.count(F.lit(1)).alias("denominator"))
    ratio_names = ("has_maker_name", "has_official_site", "has_campaign_url")
    ratios = population.agg(*[count_where(F.col(n), n) for n in ratio_names]).select(
        F.explode(F.array(*[F.struct(F.lit("evidence").alias("section"), F.lit(n).alias("key"), F.col(n).alias("n"), F.lit(i).alias("position")) for i, n in enumerate(ratio_names)])).alias("r")
    ).select("r.*")
    decisions = population.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).select(F.lit("decision").alias("section"), F.col("decision").alias("key"), "n", F.lit(0).alias("position"))
    freq = (
        population.select(F.explode("codes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("code").alias("section"), "key", "n", F.lit(0).alias("position"))
    )
    body = ratios.unionByName(decisions).unionByName(freq).join(F.broadcast(total), F.lit(True))
    head = members.withColumn("denominator", F.lit(None).cast("long"))
    return head.unionByName(body).withColumn("percent", numbers.ratio_percent(F.col("n"), F.col("denominator")))


def cross_tabulation(rows: DataFrame, row: str, col: str, col_values) -> DataFrame:
    """Two-way counts with row totals; column values are given, so no extra scan."""
    r, c = F.coalesce(F.col(row).cast("string"), F.lit("None")), F.coalesce(F.col(col).cast("string"), F.lit("None"))
    return (
        rows.groupBy(r.alias("row_value"))
        .agg(*[count_where(c == v, f"n_{v}") for v in col_values], F.count(F.lit(1)).alias("total"))
    )


def outcome(counts: dict[str, Column], any_failed: Column) -> Column:
    """Class of a finished contact search. An official site alone is no channel."""
    contacts = any_of([counts[k] > 0 for k in ("emails", "people")])
    channels = any_of([counts[k] > 0 for k in ("forms", "socials")])
    return (
        F.when(any_failed & (contacts | channels), "partial")
        .when(contacts, "with_contacts")
        .when(channels, "with_channels")
        .otherwise("none")
    )


def search_diagnostics(queries: DataFrame) -> DataFrame:
    """``queries(query, results, fallback, status, providers array<struct<provider,results>>)``
    to ``(section, key, ok, zero, succeeded)``: query totals, one row per status, one per provider."""
    got = F.coalesce(F.col("results"), F.lit(0)) > 0

    def rolled(rows, section, key):
        return (
            rows.groupBy(key.alias("key"))
            .agg(count_where(got, "ok"), count_where(~got, "zero"))
            .select(F.lit(section).alias("section"), "key", "ok", "zero", (F.col("ok") > 0).alias("succeeded"))
        )

    used = F.when(F.col("fallback"), F.lit("fallback")).otherwise("direct")
    per_provider = queries.select(F.explode("providers").alias("p")).select("p.provider", "p.results")
    return (
        rolled(queries, "query", used)
        .unionByName(rolled(queries.filter(F.col("status").isNotNull()), "status", F.col("status").cast("string")))
        .unionByName(rolled(per_provider, "provider", F.coalesce(F.col("provider"), F.lit("?"))))
    )


REQUEUE_EXCLUSIONS = {
    "already_completed_skipped": "v2_completed",
    "dummy_or_test_skipped": "dummy",
    "no_research_seed_skipped": "no_seed",
    "archived_skipped": "archived",
}


def requeue_summary(results: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row of counts over ``results(result)`` and ``excluded(reason)``."""
    r, x = F.col("result"), F.col("reason")
    rows = results.select(r, F.lit(None).cast("string").alias("reason")).unionByName(
        excluded.select(F.lit(None).cast("string").alias("result"), x)
    )
    return rows.agg(
        count_where(r.isNotNull(), "attempted"),
        count_where(r == "enqueued", "enqueued"),
        count_where(F.startswith(r, F.lit("skipped")), "skipped"),
        count_where(F.startswith(r, F.lit("failed")), "failed"),
        count_where(r == "timed_out", "timed_out"),
        count_where((r == "active_job") | (x == "active_job"), "active_job_skipped"),
        *[count_where(x == reason, name) for name, reason in REQUEUE_EXCLUSIONS.items()],
        count_where(r == "cache_reused", "cache_reused"),
        count_where(r == "gate_blocked", "gate_blocked"),
    )

"""Newest rows are aggregated by hashing, and are the same rows as by sorting."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.operators import aggregates, history, signals
from leadloom.operators.history import both, coded, decoded
from leadloom.plans import boards

CHANNELS = aggregates.CHANNELS_TYPE


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(3)
    day = lambda: dt.datetime(2000, 1, 1) + dt.timedelta(days=rng.randrange(4), microseconds=rng.randrange(3))
    some = lambda *v: rng.choice(v)
    contacts = [(some(None, 1, 2, 3), i, some(None, day()), some("completed", "failed"), some(None, "", "a@b.co"), some(None, "https://b.co/c"), some(None, "https://ig.com/b"), None, None,
                 some(None, "https://www.b.co", "https://bit.ly/x"), some(None, 70), some(None, "email", "press", "fax"), None, None) for i in range(60)]
    checks = [(some(1, 2, 3, 4), i, some(None, day()), some(None, "completed", "failed", "pending", "odd"), 3,
               some(None, [], [(k, k, some("found", "limited", "not_found", None), "", "") for k in ("amazon", "makuake", "distributor")])) for i in range(60)]
    people = [(p, i, "n", "t", some(None, -1, -5, 80), some(None, 1, 2)) for i, p in enumerate([1, 1, 2, 2, 3, 3, 4, 4] * 5)]
    head = "project_id long, id long, created_at timestamp_ntz, "
    return {
        "contacts": spark.createDataFrame(contacts, head + "status string, primary_email string, primary_contact_form_url string, instagram_url string, linkedin_url string, facebook_url string, "
                                          "official_site_url string, contactability_score int, recommended_channel string, discovered_emails array<string>, discovered_forms array<string>"),
        "japan_checks": spark.createDataFrame(checks, head + f"status string, sales_value_stars int, channels {CHANNELS}"),
        "people": spark.createDataFrame(people, "project_id long, id long, name string, title string, priority int, confidence int"),
        "researches": spark.createDataFrame([(1, 1, dt.datetime(2000, 1, 1), "completed", "good")], head + "research_status string, japan_market_fit string"),
        "success_cases": spark.createDataFrame([("Design",)], "category string"),
    }


def newest(rows, key):
    """Plain Python: the last row by key, NULL lowest."""
    low = lambda v: (v is not None, v)
    best = {}
    for r in rows:
        if r["project_id"] is not None and (r["project_id"] not in best or [low(v) for v in key(r)] > [low(v) for v in key(best[r["project_id"]])]):
            best[r["project_id"]] = r
    return best


def test_newest_rows_are_whole_rows(spark, sources):
    got = {r["project_id"]: r for r in history.latest_by_time(sources["contacts"]).collect()}
    want = newest(sources["contacts"].collect(), lambda r: (r["created_at"], r["id"]))
    assert {k: r.asDict() for k, r in got.items()} == {k: r.asDict() for k, r in want.items()}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int", "string"])
def test_order_of_two_values(spark, kind):
    texts = [None, "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "1970-01-01 00:00:00.000001", "2024-02-29 12:34:56.789"]
    firsts = [None, "-7", "0", "3"] if kind in ("int", "string") else texts
    seconds = [None, -(2**63), -1, 0, 2**63 - 1]
    rows = spark.createDataFrame([(a, b) for a in firsts for b in seconds], "a string, b long").withColumn("a", F.col("a").cast(kind))
    rows = rows.select("*", both(rows, F.col("a"), F.col("b")).alias("o"), F.struct("a", "b").alias("s"))
    wrong = rows.alias("x").crossJoin(rows.alias("y")).filter(F.expr("(x.o > y.o) <> (x.s > y.s) OR (x.o = y.o) <> (x.s = y.s)"))
    assert wrong.count() == 0


def test_rules_need_no_sorted_history(spark, sources):
    projects = spark.createDataFrame([(i, "t", "d", "d", "Design", "m", None, "kickstarter", 50, "ready", 1.0, 1.0, 1, None) for i in range(1, 6)],
                                     "id long, title string, description string, description_clean string, category string, maker_name string, maker_url string, source_site string, latest_score int, "
                                     "sales_status string, raised_amount double, goal_amount double, backers_count long, archived_at timestamp")
    labels = boards.executive_summaries(projects, **sources).select("id", "score", "recommended_channel", "has_official_site")
    fit = signals.fit_signals(projects, contacts=sources["contacts"], japan_checks=sources["japan_checks"])
    jobs = spark.createDataFrame([(1, 1, "japan_sales_check", "queued")], "project_id long, id long, job_type string, status string")
    fits = sources["contacts"].select("project_id", "id", "created_at", *[F.lit(60).alias(c) for c in ("japan_market_fit", "exclusivity", "makuake_fit", "overall_priority_score", "confidence")], F.lit(True).alias("provisional"))
    cards = boards.combined_cards(projects, assessments=fits, jobs=jobs, japan_checks=sources["japan_checks"], contacts=sources["contacts"]).select("id", "decision", "japan_state", "japan_confidence")
    for df in (labels, fit.drop("japan_evidence"), cards):
        assert "SortAggregate" not in plan(df)
        assert df.count() == 5
    checks = newest(sources["japan_checks"].collect(), lambda r: (r["id"],))
    state = lambda s: "not_checked" if s is None else s if s in ("failed", "completed") else "running"
    assert {r["id"]: r["japan_state"] for r in cards.collect()} == {**{i: state(checks[i]["status"]) if i in checks else "not_checked" for i in range(1, 6)}, 1: "queued"}


def test_best_person_with_and_without_other_columns(spark, sources):
    people = sources["people"]
    low = lambda v: -1 if v is None else v
    want = newest(people.collect(), lambda r: (low(r["priority"]), low(r["confidence"]), -r["id"]))
    got = signals.top_person(people)
    assert {r["project_id"]: tuple(r)[1:] for r in got.collect()} == {k: tuple(r)[1:] for k, r in want.items()}
    alone = got.select("project_id", "priority")
    assert "SortAggregate" not in plan(alone)
    assert {r["project_id"]: r["priority"] for r in alone.collect()} == {k: r["priority"] for k, r in want.items()}


def test_codes_and_host_patterns(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "v string")
    assert [r[0] for r in rows.select(decoded(coded(F.col("v"), ["a", "b"]), ["a", "b"])).collect()] == ["a", "b", None, None]
    hosts = [("x.com", True), ("a.x.com", True), ("ax.com", False), ("x.com.", False), ("x.com\n", False), ("xacom", False), (None, None), ("", False)]
    rows = spark.createDataFrame(hosts, "h string, u boolean")
    assert [r[0] for r in rows.select(urls.under_any(F.col("h"), ["y.net", "x.com"])).collect()] == [u for _, u in hosts]
    rules = [("shop.a.b", True), ("a.shop", True), ("shops.b", False), ("a.x.com", True), (None, None)]
    rows = spark.createDataFrame(rules, "h string, u boolean")
    assert [r[0] for r in rows.select(urls.matches_host_rules(F.col("h"), ["shop.", "x.com"])).collect()] == [u for _, u in rules]

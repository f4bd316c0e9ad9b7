"""Lists, joins, aggregates, windows and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.catalog import inputs, query
from leadloom.catalog.inputs import text
from leadloom.domain import AS_OF, CHANNELS, table, with_tables
from leadloom.functions import dates, numbers
from leadloom.functions.text import short_text, title_keywords, token_similarity
from leadloom.operators import aggregates as agg
from leadloom.operators import history, joins, sets
from leadloom.operators import projections as prj


def q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LIVE = f"source_site IN ({q(vocab.SALES_TARGET_SITES)}) AND archived_at IS NULL"
NORMAL = "CASE WHEN sales_status IS NULL THEN 'not_started' WHEN sales_status = 'won' THEN 'contract_agreed' ELSE sales_status END"
PCT = "CASE WHEN CAST(goal_amount AS DOUBLE) > 0 THEN CAST(raised_amount AS DOUBLE) / CAST(goal_amount AS DOUBLE) END"
NOW = f"TIMESTAMP '{AS_OF}'"



@query(
    "prj01_project_list",
    with_tables("projects", then=f"""
    SELECT id, title, source_site, latest_score FROM projects
    WHERE {LIVE} AND sales_status IN ('contract_agreed', 'won') AND latest_score >= 20 AND title ILIKE '%o%'"""),
)
def prj01(spark, sf):
    rows = prj.filter_projects(inputs.projects(spark, sf), sales_status="contract_agreed", min_score=20, q="O")
    return rows.select("id", "title", "source_site", "latest_score")


@query(
    "prj01_archived_list",
    with_tables("projects", then=f"""
    SELECT id, archive_reason FROM projects
    WHERE source_site IN ({q(vocab.SALES_TARGET_SITES)}) AND archived_at IS NOT NULL
      AND latest_recommendation = 'high' AND lead_qualification_decision = 'clear'"""),
)
def prj01b(spark, sf):
    rows = prj.filter_projects(inputs.projects(spark, sf), archived=True, recommendation="high", qualification="clear")
    return rows.select("id", "archive_reason")


@query(
    "prj02_success_list",
    with_tables("success_cases", then="SELECT id, title FROM success_cases WHERE platform = 'makuake' AND category = 'Design' AND title ILIKE '%r%'"),
)
def prj02(spark, sf):
    return prj.filter_success_cases(table(spark, sf, "success_cases"), platform="makuake", category="Design", q="r").select("id", "title")


@query("prj03_maker_list", with_tables("makers", then="SELECT id, name FROM makers WHERE status = 'lead' AND name ILIKE '%nova%'"))
def prj03(spark, sf):
    return prj.filter_makers(table(spark, sf, "makers"), status="lead", q="nova").select("id", "name")


@query(
    "prj04_opportunity_list",
    with_tables("opportunities", then="SELECT id, sales_score FROM opportunities WHERE status = 'contacted' AND sales_priority = 'low' AND sales_score >= 40"),
)
def prj04(spark, sf):
    rows = prj.filter_opportunities(table(spark, sf, "opportunities"), status="contacted", sales_priority="low", min_score=40)
    return rows.select("id", "sales_score")


@query("prj06_sales_status", with_tables("projects", then=f"SELECT {NORMAL} AS sales_status, count(*) AS n FROM projects GROUP BY 1"))
def prj06(spark, sf):
    rows = inputs.projects(spark, sf).select(prj.normalise_sales_status(F.col("sales_status")).alias("sales_status"))
    return rows.groupBy("sales_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj07_archive_restore",
    with_tables("projects", "contacts", then=f"""
    WITH chosen AS (SELECT DISTINCT project_id FROM contacts WHERE status = 'failed'),
    given_back AS (SELECT DISTINCT project_id FROM contacts WHERE recommended_channel = 'press')
    SELECT id,
      CAST(CASE WHEN g.project_id IS NOT NULL THEN NULL WHEN c.project_id IS NOT NULL AND archived_at IS NULL THEN {NOW} ELSE archived_at END AS VARCHAR) AS archived_at,
      CASE WHEN g.project_id IS NOT NULL THEN NULL WHEN c.project_id IS NOT NULL THEN 'unreachable' ELSE archive_reason END AS archive_reason
    FROM projects p LEFT JOIN chosen c ON p.id = c.project_id LEFT JOIN given_back g ON p.id = g.project_id"""),
)
def prj07(spark, sf):
    found = inputs.contacts(spark, sf)
    chosen = found.filter("status = 'failed'").select(F.col("project_id").alias("id"))
    back = found.filter("recommended_channel = 'press'").select(F.col("project_id").alias("id"))
    rows = prj.restore(prj.archive(inputs.projects(spark, sf), chosen, AS_OF, "unreachable"), back)
    return rows.select("id", text("archived_at"), "archive_reason")


RATE = "CASE WHEN raised_amount > 0 AND goal_amount > 0 THEN CAST(round_even(CAST(raised_amount AS DOUBLE) / CAST(goal_amount AS DOUBLE) * 100, 0) AS BIGINT) END"


@query(
    "prj09_compact_facts",
    with_tables("projects", then=f"""
    SELECT id, category, CASE WHEN end_date < CAST({NOW} AS DATE) THEN 'ended' WHEN end_date IS NOT NULL THEN 'live' END AS campaign_state,
      CASE WHEN end_date >= CAST({NOW} AS DATE) THEN CAST(date_diff('day', CAST({NOW} AS DATE), end_date) AS INT) END AS days_remaining,
      {RATE} AS funding_rate, backers_count, CAST(raised_amount AS DOUBLE) AS raised_amount, currency FROM projects"""),
)
def prj09(spark, sf):
    return prj.compact_facts(inputs.projects(spark, sf), AS_OF)


@query(
    "prj10_fact_status",
    with_tables("projects", then="""
    WITH f AS (SELECT id, unnest([{'l': 'title', 'v': title}, {'l': 'category', 'v': category}, {'l': 'site', 'v': source_site},
      {'l': 'start_date', 'v': CAST(start_date AS VARCHAR)}, {'l': 'end_date', 'v': CAST(end_date AS VARCHAR)},
      {'l': 'backers', 'v': CAST(backers_count AS VARCHAR)}]) AS x FROM projects)
    SELECT x.l AS label, CASE WHEN x.v IS NULL OR trim(x.v) = '' THEN 'not_acquired' ELSE 'acquired' END AS status,
      count(*) AS n, count(DISTINCT x.v) FILTER (WHERE x.v IS NOT NULL AND trim(x.v) <> '') AS n_values FROM f GROUP BY 1, 2"""),
)
def prj10(spark, sf):
    rows = prj.project_facts(inputs.projects(spark, sf), AS_OF)
    rows = rows.filter(F.col("label").isin("title", "category", "site", "start_date", "end_date", "backers"))
    return rows.groupBy("label", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query(
    "prj11_evaluation_cost",
    with_tables("projects", then="""
    SELECT count(*) AS "count", count(*) * 700 AS est_input_tokens, count(*) * 300 AS est_output_tokens,
      round_even(count(*) * 700 / 1000000.0 * 3.0 + count(*) * 300 / 1000000.0 * 15.0, 6)::DOUBLE AS est_cost_usd
    FROM projects WHERE latest_score IS NULL AND archived_at IS NULL"""),
)
def prj11(spark, sf):
    prices = spark.createDataFrame([("model-a", 3.0, 15.0), ("model-b", 1.0, 5.0)], "model string, usd_in double, usd_out double")
    return prj.evaluation_cost(inputs.projects(spark, sf), prices, "model-a")


@query(
    "prj12_recipient",
    with_tables("contacts", then="""
    SELECT project_id, CASE WHEN primary_email <> '' THEN primary_email ELSE found_email END AS recipient
    FROM contacts QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) = 1"""),
)
def prj12(spark, sf):
    newest = history.latest_by_id(inputs.contacts(spark, sf), columns=["primary_email", "discovered_emails"])
    return prj.recipient(newest)


@query(
    "sort01_project_page",
    with_tables("projects", then=f"SELECT id, title, latest_score FROM projects WHERE {LIVE} ORDER BY latest_score DESC NULLS LAST, id LIMIT 50 OFFSET 100"),
)
def sort01(spark, sf):
    rows = prj.filter_projects(inputs.projects(spark, sf))
    return prj.sort_and_page(rows, prj.PROJECT_SORTS, "latest_score", "desc", page=3, page_size=50).select("id", "title", "latest_score")


@query(
    "sort02_opportunity_due",
    with_tables("opportunities", then="""
    SELECT id, sales_score, row_number() OVER (ORDER BY next_action_due_date NULLS LAST, sales_score DESC, id) AS rank
    FROM opportunities QUALIFY rank <= 100"""),
)
def sort02(spark, sf):
    rows = table(spark, sf, "opportunities")
    return history.top_k(rows, prj.order_opportunities(rows, "due_date"), 100).select("id", "sales_score", F.col("rank").cast("long").alias("rank"))


@query(
    "sort08_reminders",
    with_tables("makers", then=f"""
    SELECT id AS maker_id, name AS maker_name, status, next_action, CAST(next_action_date AS VARCHAR) AS next_action_date,
      next_action_date < CAST({NOW} AS DATE) AS overdue FROM makers
    WHERE next_action_date <= CAST({NOW} AS DATE) + 7"""),
)
def sort08(spark, sf):
    rows = prj.reminders(table(spark, sf, "makers"), AS_OF, within_days=7)
    return rows.withColumn("next_action_date", F.col("next_action_date").cast("string"))


# --- joins -----------------------------------------------------------------------

@query(
    "join01_latest_assessment",
    with_tables("projects", "assessments", then="""
    SELECT p.id, a.exclusivity AS a_exclusivity, a.confidence AS a_confidence FROM projects p
    LEFT JOIN (SELECT * FROM assessments QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) = 1) a ON a.project_id = p.id"""),
)
def join01(spark, sf):
    rows = history.join_latest(inputs.projects(spark, sf), table(spark, sf, "assessments"), "a_", ["exclusivity", "confidence"])
    return rows.select("id", "a_exclusivity", "a_confidence")


@query(
    "join02_latest_japan_job",
    with_tables("jobs", then="SELECT project_id, max(id) AS id, arg_max(status, id) AS status FROM jobs WHERE job_type = 'japan_sales_check' GROUP BY 1"),
)
def join02(spark, sf):
    return history.latest_by_id(table(spark, sf, "jobs"), where=F.col("job_type") == "japan_sales_check", columns=["id", "status"])


@query(
    "join03_lateral_latest",
    with_tables("projects", "contacts", then="""
    SELECT p.id, c.id AS contact_id, c.status FROM projects p
    LEFT JOIN LATERAL (SELECT * FROM contacts c WHERE c.project_id = p.id ORDER BY c.id DESC LIMIT 1) c ON true WHERE p.archived_at IS NULL"""),
)
def join03(spark, sf):
    newest = history.latest_by_id(table(spark, sf, "contacts"), columns=[F.col("id").alias("contact_id"), "status"])
    left = inputs.projects(spark, sf).filter("archived_at IS NULL").select("id")
    return left.join(newest.withColumnRenamed("project_id", "id"), "id", "left")


PREP = """
flags AS (SELECT p.*, EXISTS (SELECT 1 FROM researches r WHERE r.project_id = p.id AND r.research_status = 'completed') AS research_done,
  EXISTS (SELECT 1 FROM contacts c WHERE c.project_id = p.id) AS contact_done,
  EXISTS (SELECT 1 FROM drafts d WHERE d.project_id = p.id) AS email_done FROM projects p)"""
HISTORIES = ("projects", "researches", "contacts", "drafts")


def history_tables(spark, sf):
    return [table(spark, sf, n) for n in HISTORIES]


@query("join04_prepared", with_tables(*HISTORIES, then=f"WITH {PREP} SELECT id FROM flags WHERE research_done AND contact_done AND email_done"))
def join04(spark, sf):
    return joins.prepared(*history_tables(spark, sf)).select("id")


@query(
    "join05_reachable",
    with_tables("projects", "contacts", then="""
    SELECT id, title FROM projects p WHERE EXISTS (SELECT 1 FROM contacts c WHERE c.project_id = p.id
      AND coalesce(primary_email, primary_contact_form_url, instagram_url, linkedin_url, facebook_url) IS NOT NULL)"""),
)
def join05(spark, sf):
    return joins.reachable(inputs.projects(spark, sf), table(spark, sf, "contacts")).select("id", "title")


@query(
    "join06_not_assessed",
    with_tables("projects", "assessments", then=f"SELECT id FROM projects p WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM assessments a WHERE a.project_id = p.id)"),
)
def join06(spark, sf):
    return joins.not_assessed(inputs.projects(spark, sf), table(spark, sf, "assessments")).select("id")


WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9\\-]{{2,}}'))"
SIMILAR = with_tables("projects", "success_cases", then=f"""
    WITH c AS (SELECT id AS case_id, category, {WORDS.format('title')} AS kw, raised_amount,
      CASE WHEN raised_amount <> 0 AND goal_amount <> 0 THEN round_even(CAST(raised_amount AS DOUBLE) / CAST(goal_amount AS DOUBLE) * 100, 0) END AS rate FROM success_cases),
    b AS (SELECT *, CASE WHEN rate >= 1000 THEN 25 WHEN rate >= 300 THEN 15 WHEN rate >= 100 THEN 8 ELSE 0 END AS bonus FROM c),
    pairs AS (SELECT p.id AS project_id, case_id, bonus, coalesce(p.category = b.category AND p.category <> '', false) AS same,
      len(list_intersect({WORDS.format('p.title')}, b.kw)) AS n FROM projects p CROSS JOIN b),
    scored AS (SELECT *, least(100, CASE WHEN same THEN 70 ELSE 0 END + least(15, 5 * n) + bonus) AS score FROM pairs WHERE same OR n > 0),
    ranked AS (SELECT project_id, case_id, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, case_id) AS rank FROM scored QUALIFY rank <= 3),
    funded AS (SELECT case_id, raised_amount, greatest(1, bonus) AS score FROM b ORDER BY coalesce(raised_amount, 0) DESC, case_id LIMIT 3),
    listed AS (SELECT *, row_number() OVER (ORDER BY score DESC, coalesce(raised_amount, 0) DESC, case_id) AS rank FROM funded)
    SELECT project_id, CAST(rank AS INT) AS rank, case_id, CAST(score AS INT) AS score FROM ranked
    UNION ALL SELECT p.id, CAST(rank AS INT), case_id, CAST(score AS INT) FROM projects p CROSS JOIN listed WHERE p.id NOT IN (SELECT project_id FROM ranked)""")


@query("join07_similar_cases", SIMILAR)
def join07(spark, sf):
    rows = joins.similar_cases(inputs.projects(spark, sf), table(spark, sf, "success_cases"), 3)
    return rows.select("project_id", "rank", "case_id", F.col("score").cast("int").alias("score"))


@query(
    "join08_same_category",
    with_tables("projects", "success_cases", then="""
    SELECT id, trim(category) <> '' AND trim(category) IN (SELECT category FROM success_cases WHERE category IS NOT NULL) IS TRUE AS exact_match,
      coalesce(lower(trim(category)) IN (SELECT lower(trim(category)) FROM success_cases WHERE category IS NOT NULL), false) AS folded_match FROM projects""".replace("trim(category) <> '' AND trim(category) IN (SELECT category FROM success_cases WHERE category IS NOT NULL) IS TRUE", "coalesce(trim(category) IN (SELECT category FROM success_cases WHERE category IS NOT NULL), false)")),
)
def join08(spark, sf):
    cases = table(spark, sf, "success_cases")
    rows = joins.same_category_exists(inputs.projects(spark, sf), cases).withColumnRenamed("similar_category", "exact_match")
    rows = joins.same_category_exists(rows, cases, fold_case=True).withColumnRenamed("similar_category", "folded_match")
    return rows.select("id", "exact_match", "folded_match")


@query(
    "join10_capture_projects",
    with_tables("projects", then="""
    WITH cap AS (SELECT id AS capture_id, CASE id % 3 WHEN 0 THEN source_url WHEN 1 THEN source_url || '#story' ELSE upper(source_url) END AS url FROM projects WHERE source_url IS NOT NULL),
    k AS (SELECT *, nullif(regexp_extract(url, '/campaign/(?:detail|example)/([A-Za-z0-9_\\-]+)', 1), '') AS cid,
      rtrim(lower(regexp_extract(trim(url), '^([^?#]*)', 1)), '/') AS canon FROM cap),
    p AS (SELECT id, source_url, nullif(regexp_extract(source_url, '/campaign/(?:detail|example)/([A-Za-z0-9_\\-]+)', 1), '') AS cid,
      rtrim(lower(regexp_extract(trim(source_url), '^([^?#]*)', 1)), '/') AS canon FROM projects WHERE source_site = 'wadiz' AND source_url IS NOT NULL),
    hits AS (SELECT capture_id, p.id AS project_id, 1 AS tier FROM k JOIN projects p ON k.url = p.source_url
      UNION ALL SELECT capture_id, p.id, 2 FROM k JOIN p ON k.cid = p.cid UNION ALL SELECT capture_id, p.id, 3 FROM k JOIN p ON k.canon = p.canon)
    SELECT * FROM hits QUALIFY tier = min(tier) OVER (PARTITION BY capture_id)"""),
)
def join10(spark, sf):
    rows = inputs.projects(spark, sf)
    url = F.col("source_url")
    n = F.col("id") % 3
    captures = rows.filter(url.isNotNull()).select(
        F.col("id").alias("capture_id"),
        F.when(n == 0, url).when(n == 1, F.concat(url, F.lit("#story"))).otherwise(F.upper(url)).alias("url"),
    )
    return joins.resolve_captures(captures, rows)


@query(
    "join11_unvisited",
    "SELECT url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (SELECT url || '/' AS url FROM pages WHERE length(html) > 4000) v WHERE rtrim(v.url, '/') = rtrim(p.url, '/'))",
)
def join11(spark, sf):
    pages = table(spark, sf, "pages").select("url", "html")
    visited = pages.filter(F.length("html") > 4000).select(F.concat("url", F.lit("/")).alias("url"))
    return joins.unvisited(pages.select("url"), visited)


@query(
    "join12_robots",
    """
    WITH p AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT host, '/' || split_part(min(path), '/', 2) || '/' AS prefix FROM p GROUP BY host)
    SELECT page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.host = p.host AND starts_with(p.path, r.prefix))""",
)
def join12(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^?#]*)", 1))
    hosts = pages.select(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#]*)", 1).alias("host"), path.alias("path"))
    first = hosts.groupBy("host").agg(F.min("path").alias("path"))
    lines = F.concat(
        F.lit("User-agent: other\nDisallow: /\n# note\nUser-agent: *\nDisallow:\nDisallow: /"),
        F.split_part("path", F.lit("/"), F.lit(2)),
        F.lit("/\n"),
    )
    robots = first.select("host", lines.alias("robots_txt"))
    return joins.allowed_by_robots(pages, joins.parse_robots(robots)).select("page_id")


# --- aggregates --------------------------------------------------------------------

@query(
    "agg01_sales_kpis",
    with_tables(*HISTORIES, then=f"""WITH {PREP}
    SELECT count(*) FILTER (WHERE sales_status IN ('not_started', 'ready') AND research_done AND contact_done AND email_done) AS ready_count,
      count(*) FILTER (WHERE sales_status IN ('not_started', 'ready') AND research_done AND contact_done AND email_done) AS today_count,
      count(*) FILTER (WHERE sales_status = 'awaiting_reply') AS awaiting_reply_count, count(*) FILTER (WHERE sales_status = 'replied') AS replied_count,
      count(*) FILTER (WHERE sales_status = 'negotiating') AS negotiating_count,
      count(*) FILTER (WHERE sales_status IN ('contract_agreed', 'import_prep', 'jp_cf_prep', 'selling', 'won')) AS won_count,
      count(*) FILTER (WHERE sales_status IN ('contract_agreed', 'won')) AS contract_agreed_count,
      count(*) FILTER (WHERE sales_status = 'selling') AS selling_count, count(*) FILTER (WHERE sales_status = 'contacted') AS contacted_count
    FROM flags WHERE {LIVE}"""),
)
def agg01(spark, sf):
    return agg.sales_kpis(*history_tables(spark, sf))


USAGE_AS_OF = "2024-01-20 12:00:00"
_PERIODS = {"today": "created_at >= TIMESTAMP '2024-01-20 00:00:00'", "month": "created_at >= TIMESTAMP '2024-01-01 00:00:00'", "total": "true"}


@query(
    "agg02_usage",
    with_tables("usage_logs", then="SELECT " + ", ".join(
        f"CAST(coalesce(sum(cost_usd) FILTER (WHERE {c}), 0) AS DOUBLE) AS {p}_cost_usd, CAST(coalesce(sum(input_tokens) FILTER (WHERE {c}), 0) AS BIGINT) AS {p}_input_tokens, "
        f"CAST(coalesce(sum(output_tokens) FILTER (WHERE {c}), 0) AS BIGINT) AS {p}_output_tokens, count(*) FILTER (WHERE {c}) AS {p}_calls"
        for p, c in _PERIODS.items()) + " FROM usage_logs"),
)
def agg02(spark, sf):
    rows = agg.usage_summary(table(spark, sf, "usage_logs"), USAGE_AS_OF)
    return rows.select(*[F.col(c).cast("double").alias(c) if c.endswith("cost_usd") else F.col(c).cast("long").alias(c) for c in rows.columns])


LAST = """outreach_at AS (SELECT coalesce(a.project_id, d.project_id) AS project_id, coalesce(a.t, d.t) AS last_outreach_at
  FROM (SELECT project_id, max(occurred_at) AS t FROM activities GROUP BY 1) a FULL JOIN (SELECT project_id, max(created_at) AS t FROM drafts GROUP BY 1) d ON a.project_id = d.project_id)"""


@query("agg03_last_outreach", with_tables("activities", "drafts", then=f"WITH {LAST} SELECT project_id, CAST(last_outreach_at AS VARCHAR) AS last_outreach_at FROM outreach_at"))
def agg03(spark, sf):
    rows = agg.last_outreach(table(spark, sf, "activities"), table(spark, sf, "drafts"))
    return rows.select("project_id", text("last_outreach_at"))


HEALTH = f"""
recent AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY started_at DESC, id DESC) AS rn, coalesce(finished_at, started_at) AS run_at,
    coalesce(error_kind, 'unknown') AS kind FROM scrape_runs WHERE status <> 'running' QUALIFY rn <= 20),
st AS (SELECT site, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
    count(*) FILTER (WHERE status <> 'success' AND kind = 'network') AS network_errors, count(*) FILTER (WHERE status <> 'success' AND kind = 'structure') AS structure_errors,
    count(*) FILTER (WHERE status <> 'success' AND kind NOT IN ('network', 'structure')) AS unknown_errors,
    count(*) FILTER (WHERE status <> 'success' AND error LIKE '%403%') AS http_403_count, arg_min(status, rn) AS last_status,
    arg_min(run_at, rn) FILTER (WHERE status = 'success') AS ok_at, arg_min(run_at, rn) FILTER (WHERE status <> 'success') AS bad_at,
    arg_min(run_at, rn) FILTER (WHERE status <> 'success' AND kind = 'structure') AS st_at FROM recent GROUP BY site),
sites AS (SELECT unnest([{q(vocab.MONITORED_SITES)}]) AS site),
health AS (SELECT sites.site, coalesce(total, 0) AS total, coalesce(success, 0) AS success, coalesce(network_errors, 0) AS network_errors,
    coalesce(structure_errors, 0) AS structure_errors, coalesce(unknown_errors, 0) AS unknown_errors, coalesce(http_403_count, 0) AS http_403_count,
    last_status, ok_at, bad_at, st_at, CASE WHEN total > 0 THEN round_even(success / total, 4) END AS success_rate,
    coalesce(structure_errors, 0) > 0 AND NOT coalesce(ok_at > st_at, false) AS structure_change_suspected
  FROM sites LEFT JOIN st USING (site)),
report AS (SELECT *, coalesce(network_errors + structure_errors + unknown_errors > 0 AND success_rate < 0.5, false) AS degraded FROM health)"""


@query(
    "agg04_source_health",
    with_tables("scrape_runs", then=f"""WITH {HEALTH} SELECT site, total, success, network_errors, structure_errors, unknown_errors, http_403_count, last_status,
    success_rate, structure_change_suspected, degraded, CAST(ok_at AS VARCHAR) AS last_success_at, CAST(bad_at AS VARCHAR) AS last_failure_at FROM report"""),
)
def agg04(spark, sf):
    rows = agg.source_health(table(spark, sf, "scrape_runs"))
    return rows.select("site", "total", "success", "network_errors", "structure_errors", "unknown_errors", "http_403_count", "last_status",
                       "success_rate", "structure_change_suspected", "degraded", text("last_success_at"), text("last_failure_at"))


@query(
    "agg05_job_rollup",
    with_tables("scrape_runs", then="""
    SELECT job_run_id, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'error') AS failed,
      CASE WHEN failed = 0 AND succeeded > 0 THEN 'success' WHEN succeeded > 0 AND failed > 0 THEN 'partial' ELSE 'error' END AS job_status
    FROM scrape_runs GROUP BY 1"""),
)
def agg05(spark, sf):
    return agg.job_rollup(table(spark, sf, "scrape_runs"))


@query(
    "agg06_alerts",
    with_tables("scrape_runs", then=f"""WITH {HEALTH} SELECT site, concat_ws(',', CASE WHEN structure_change_suspected THEN 'structure_change' END, CASE WHEN degraded THEN 'low_success_rate' END) AS issues,
    network_errors, structure_errors, unknown_errors, http_403_count, success_rate FROM report
    WHERE (structure_change_suspected OR degraded) AND (SELECT bool_or(structure_change_suspected) FROM report)"""),
)
def agg06(spark, sf):
    rows = agg.alerts(agg.source_health(table(spark, sf, "scrape_runs")))
    return rows.drop("last_error_at", "last_structure_error_at")


@query(
    "agg07_availability",
    with_tables("availability_checks", "availability_hits", then="""
    WITH b AS (SELECT check_id, max(match_score) AS score, string_agg(DISTINCT site, ',' ORDER BY site) AS sites_hit, arg_max(site, (match_score, -id)) AS top_site FROM availability_hits GROUP BY 1)
    SELECT c.id, c.project_id, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) >= 80 THEN 'sold' WHEN coalesce(score, 0) >= 50 THEN 'possible' ELSE 'not_landed' END AS verdict,
      coalesce(sites_hit, '') AS sites_hit, top_site FROM availability_checks c LEFT JOIN b ON c.id = b.check_id"""),
)
def agg07(spark, sf):
    return agg.availability(table(spark, sf, "availability_checks"), table(spark, sf, "availability_hits"))


_N = lambda keys, st: " + ".join(f"CASE WHEN ch_{k} IN ({q(st)}) THEN 1 ELSE 0 END" for k in keys)
_FOUND, _LIMITED = ("found",), ("limited",)
SHOPS, DIST, CF = _N(vocab.SHOP_CHANNELS, _FOUND), _N(vocab.DISTRIBUTOR_CHANNELS, _FOUND), _N(vocab.DOMESTIC_CROWDFUNDING_CHANNELS, _FOUND)


@query(
    "agg08_presence_stars",
    with_tables("japan_checks", then=f"""
    SELECT id, CAST(CASE WHEN {DIST} > 0 THEN CASE WHEN {SHOPS} >= 2 THEN 1 ELSE 2 END WHEN {SHOPS} >= 2 THEN 1 WHEN {SHOPS} = 1 THEN 3
      WHEN {_N(vocab.SHOP_CHANNELS, _LIMITED)} >= 1 OR {CF} > 0 THEN 4 ELSE 5 END AS INT) AS stars FROM japan_checks"""),
)
def agg08(spark, sf):
    return inputs.japan_checks(spark, sf).select("id", agg.presence_stars(F.col("channels")).alias("stars"))


SEEN = ("found", "limited")
INTERPRET = f"""interpreted AS (SELECT c.*, {_N(CHANNELS, SEEN)} AS n_found, {_N(CHANNELS, ('not_found',))} AS n_absent,
    {_N(vocab.PRESENCE_CHANNELS, SEEN)} > 0 AS presence, {_N(vocab.DOMESTIC_CROWDFUNDING_CHANNELS, SEEN)} > 0 AS on_cf FROM japan_checks c),
japan AS (SELECT *, CASE status WHEN 'failed' THEN 'failed' WHEN 'completed' THEN 'completed' ELSE 'running' END AS japan_state,
    CASE WHEN status = 'completed' THEN CASE WHEN presence OR on_cf THEN 'sold_in_japan' WHEN n_found + n_absent >= 3 AND n_found = 0 THEN 'not_found_in_japan' ELSE 'inconclusive' END END AS japan_result,
    CAST(CASE WHEN status <> 'completed' THEN 0 WHEN presence THEN 85 WHEN on_cf THEN 70 WHEN n_found + n_absent >= 3 AND n_found = 0 THEN least(65, 40 + floor((n_found + n_absent) / {len(CHANNELS)}.0 * 30)) ELSE 25 END AS INT) AS japan_confidence
  FROM interpreted)"""


@query(
    "agg09_japan_interpretation",
    with_tables("japan_checks", then=f"WITH {INTERPRET} SELECT id, japan_state, japan_result, japan_confidence, CAST(CASE WHEN status = 'completed' THEN n_found ELSE 0 END AS INT) AS n_evidence, CAST(CASE WHEN status = 'completed' THEN n_found + n_absent ELSE 0 END AS INT) AS n_urls FROM japan"),
)
def agg09(spark, sf):
    rows = inputs.japan_checks(spark, sf)
    rows = rows.withColumns(agg.interpret_japan(F.col("status"), F.col("channels")))
    return rows.select("id", "japan_state", "japan_result", "japan_confidence", F.size("japan_evidence").alias("n_evidence"), F.size("japan_source_urls").alias("n_urls"))


@query(
    "agg10_presence_context",
    with_tables("japan_checks", then=f"SELECT id, {DIST} > 0 AS has_distributor, {SHOPS} > 0 AS sold_in_japan, NOT ({DIST} > 0) AND NOT ({SHOPS} > 0) AS no_japan_presence FROM japan_checks WHERE status = 'completed'"),
)
def agg10(spark, sf):
    rows = inputs.japan_checks(spark, sf).filter("status = 'completed'")
    return rows.select("id", *[c.alias(n) for n, c in agg.presence_flags(F.col("channels")).items()])


@query(
    "agg11_mean_axis",
    with_tables("assessments", then="""
    WITH m AS (SELECT id, CAST(round_even((japan_market_fit + exclusivity + makuake_fit + confidence) / 4.0, 0) AS INT) AS score FROM assessments)
    SELECT id, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'mid' ELSE 'low' END AS recommendation FROM m"""),
)
def agg11(spark, sf):
    axes = F.create_map(*[x for n in ("japan_market_fit", "exclusivity", "makuake_fit", "confidence") for x in (F.lit(n), F.col(n))])
    score, label = agg.mean_axis_score(axes)
    return table(spark, sf, "assessments").select("id", score.alias("score"), label.alias("recommendation"))


@query(
    "agg14_site_by_status",
    with_tables("projects", then="""
    SELECT source_site AS row_value, count(*) FILTER (WHERE latest_recommendation = 'high') AS n_high, count(*) FILTER (WHERE latest_recommendation = 'mid') AS n_mid,
      count(*) FILTER (WHERE latest_recommendation = 'low') AS n_low, count(*) FILTER (WHERE latest_recommendation IS NULL) AS "n_None", count(*) AS total FROM projects GROUP BY 1"""),
)
def agg14(spark, sf):
    return agg.cross_tabulation(inputs.projects(spark, sf), "source_site", "latest_recommendation", ("high", "mid", "low", "None"))


@query(
    "agg15_ratio",
    with_tables("projects", then="""
    SELECT source_site, count(*) FILTER (WHERE archived_at IS NOT NULL) AS numerator, count(*) FILTER (WHERE sales_status = 'selling') AS denominator,
      CASE WHEN denominator <> 0 THEN round_even(numerator * 100.0::DOUBLE / denominator, 1) END AS percent FROM projects GROUP BY 1"""),
)
def agg15(spark, sf):
    rows = inputs.projects(spark, sf).groupBy("source_site").agg(
        agg.count_where(F.col("archived_at").isNotNull(), "numerator"), agg.count_where(F.col("sales_status") == "selling", "denominator")
    )
    return rows.withColumn("percent", numbers.ratio_percent(F.col("numerator"), F.col("denominator")))


# --- windows ---------------------------------------------------------------------------

@query(
    "win01_latest_by_time",
    with_tables("contacts", then="SELECT project_id, id, status FROM contacts QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1"),
)
def win01(spark, sf):
    return history.latest_by_time(table(spark, sf, "contacts"), columns=["id", "status"])


@query(
    "win02_last_runs",
    with_tables("scrape_runs", then="SELECT site, id, CAST(row_number() OVER (PARTITION BY site ORDER BY started_at DESC, id DESC) AS INT) AS rn FROM scrape_runs WHERE status <> 'running' QUALIFY rn <= 20"),
)
def win02(spark, sf):
    runs = table(spark, sf, "scrape_runs").filter("status <> 'running'")
    return history.last_n(runs, "site", [F.col("started_at").desc(), F.col("id").desc()], 20).select("site", "id", "rn")


@query(
    "win03_status_history",
    with_tables("status_events", then="SELECT project_id, id, to_status, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS INT) AS rn FROM status_events QUALIFY rn <= 100"),
)
def win03(spark, sf):
    return history.history_listing(table(spark, sf, "status_events"), 100).select("project_id", "id", "to_status", "rn")


@query(
    "win04_rank_number",
    with_tables("projects", then=f"SELECT id, CAST(row_number() OVER (ORDER BY latest_score DESC NULLS LAST, id) AS INT) AS rank FROM projects WHERE {LIVE} QUALIFY rank <= 20"),
)
def win04(spark, sf):
    rows = prj.target_projects(inputs.projects(spark, sf))
    return history.top_k(rows, [F.col("latest_score").desc_nulls_last(), F.col("id").asc()], 20).select("id", "rank")


@query(
    "win06_first_per_maker",
    with_tables("projects", then="""
    SELECT id, maker_key FROM (SELECT id, nullif(lower(trim(maker_name)), '') AS maker_key FROM projects)
    QUALIFY maker_key IS NULL OR row_number() OVER (PARTITION BY maker_key ORDER BY id) = 1"""),
)
def win06(spark, sf):
    rows = inputs.projects(spark, sf).select("id", F.nullif(F.lower(F.trim("maker_name")), F.lit("")).alias("maker_key"))
    return history.first_per_key(rows, "maker_key", "id")


@query(
    "win07_best_candidate",
    with_tables("opportunities", then="""
    SELECT CAST(next_action_due_date AS VARCHAR) AS due, arg_max(id, (CASE sales_priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, -id)) AS id,
      string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM opportunities WHERE next_action_due_date IS NOT NULL GROUP BY 1"""),
)
def win07(spark, sf):
    rows = table(spark, sf, "opportunities").filter(F.col("next_action_due_date").isNotNull()).withColumn("due", F.col("next_action_due_date").cast("string"))
    return sets.best_candidate(rows, ["due"], F.col("sales_priority"), ("high", "medium", "low"), "id", "status").select("due", "id", F.array_join("sources", ",").alias("statuses"))


@query(
    "win08_round_robin",
    with_tables("projects", then="""
    WITH g AS (SELECT id, coalesce(latest_recommendation, 'None') || '|' || coalesce(category, 'None') AS group_key, sha256(CAST(id AS VARCHAR)) AS h FROM projects)
    SELECT id, group_key, row_number() OVER (PARTITION BY group_key ORDER BY h) AS turn FROM g"""),
)
def win08(spark, sf):
    rows = inputs.projects(spark, sf).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    return history.round_robin(rows, ["latest_recommendation", "category"], ["h"]).select("id", "group_key", "turn")


# --- sets and functions --------------------------------------------------------------------

_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\\-]+'))"


@query(
    "set01_token_similarity",
    with_tables("projects", then=f"""
    WITH t AS (SELECT id, {_TOK.format('title')} AS a, {_TOK.format('description')} AS b FROM projects)
    SELECT id, CAST(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round_even(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 100, 0) END AS INT) AS score FROM t"""),
)
def set01(spark, sf):
    return inputs.projects(spark, sf).select("id", token_similarity(F.col("title"), F.col("description")).alias("score"))


@query(
    "set03_task_rows",
    with_tables("projects", then=f"SELECT DISTINCT id FROM projects WHERE {LIVE} AND sales_status IN ('not_started', 'ready', 'contacted', 'awaiting_reply', 'replied')"),
)
def set03(spark, sf):
    live = prj.target_projects(inputs.projects(spark, sf))
    parts = [live.filter(F.col("sales_status").isin(*s)) for s in (vocab.READY_STATUSES, vocab.READY_STATUSES, vocab.FOLLOWUP_STATUSES, ("replied",))]
    return sets.union_ids(*parts)


@query(
    "math03_funding_rates",
    with_tables("projects", then=f"SELECT id, {PCT} AS ratio, CAST(round_even(({PCT}) * 100, 0) AS BIGINT) AS rounded, CAST(trunc(({PCT}) * 100) AS BIGINT) AS truncated FROM projects"),
)
def math03(spark, sf):
    r, g = F.col("raised_amount"), F.col("goal_amount")
    return inputs.projects(spark, sf).select("id", numbers.funding_ratio(r, g).alias("ratio"), numbers.funding_percent_rounded(r, g).alias("rounded"), numbers.funding_percent_truncated(r, g).alias("truncated"))


_BAND = lambda steps, d: "CASE " + " ".join(f"WHEN latest_score >= {b} THEN {v}" for b, v in steps) + f" ELSE {d} END"


@query(
    "math04_score_bands",
    with_tables("projects", then=f"""
    SELECT id, CASE WHEN latest_score IS NOT NULL THEN {_BAND([(80, "'A'"), (65, "'B'"), (50, "'C'"), (35, "'D'")], "'E'")} END AS grade,
      {_BAND([(80, 5), (60, 4), (40, 3), (20, 2)], 1)} AS workflow_stars, {_BAND([(85, 5), (65, 4), (45, 3), (25, 2)], 1)} AS executive_stars,
      {_BAND([(67, "'high'"), (40, "'mid'")], "'low'")} AS level, {_BAND([(70, "'high'"), (40, "'medium'")], "'low'")} AS priority FROM projects"""),
)
def math04(spark, sf):
    s = F.col("latest_score")
    return inputs.projects(spark, sf).select("id", numbers.grade(s).alias("grade"), numbers.workflow_stars(s).alias("workflow_stars"), numbers.executive_stars(s).alias("executive_stars"), numbers.fit_level(s).alias("level"), numbers.sales_priority(s).alias("priority"))


@query(
    "date01_days_since",
    f"""SELECT o_orderkey, CAST(greatest(0, floor(epoch({NOW} - o_orderdate) / 86400)) AS INT) AS days,
      CASE WHEN days < 3 THEN NULL WHEN days >= 14 THEN 'final' WHEN days >= 7 THEN 'high' ELSE 'normal' END AS level FROM orders""",
)
def date01(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", dates.days_since(AS_OF, F.col("o_orderdate")).alias("days"))
    return rows.withColumn("level", dates.followup_level(F.col("days")))


@query(
    "date02_business_days",
    """SELECT event_id, CAST((SELECT max(d) FROM (SELECT ts + INTERVAL (k) DAY AS d, row_number() OVER (ORDER BY k) AS n FROM range(1, 20) r(k)
      WHERE isodow(ts + INTERVAL (k) DAY) < 6) WHERE n <= 5) AS VARCHAR) AS due FROM events""",
)
def date02(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.add_business_days(F.col("ts"), 5).cast("string").alias("due"))


@query(
    "date03_age_bucket",
    with_tables("projects", then=f"SELECT id, CASE WHEN end_date IS NULL THEN 'unknown' WHEN end_date < CAST({NOW} AS DATE) THEN 'ended' ELSE 'live' END AS age FROM projects"),
)
def date03(spark, sf):
    return inputs.projects(spark, sf).select("id", dates.age_bucket(F.col("end_date"), AS_OF).alias("age"))


@query("txt04_title_keywords", with_tables("projects", then=f"SELECT id, array_to_string(list_sort({WORDS.format('title')}), ' ') AS keywords FROM projects"))
def txt04(spark, sf):
    return inputs.projects(spark, sf).select("id", F.array_join(F.array_sort(title_keywords(F.col("title"))), " ").alias("keywords"))


@query(
    "txt01_short_documents",
    "WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 160 THEN t ELSE substr(t, 1, 159) || '…' END AS short FROM f",
)
def txt01s(spark, sf):
    return table(spark, sf, "documents").select("doc_id", short_text(F.col("text")).alias("short"))



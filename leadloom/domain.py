"""Domain tables derived from the star-schema test tables.

The test data holds parts, orders, events, pages and documents, not campaigns. Each
domain table is one SQL text in the subset that Spark and DuckDB read alike, so a
query and its check start from the same rows. ``{name}`` refers to a base table or
to another domain table.

Text columns are built from the row's own keys so that every rule vocabulary is hit.
Every child table has a row for each line item, and every part is a project or, the
largest, a domestic success case. So that some projects have no child of a kind, each
child table leaves the parts of one residue out and gives their rows to the next part.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2000-06-15 09:30:00"


def _pick(key: str, values, null_at=()) -> str:
    """CASE over a residue; NULL for the listed positions."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if i in null_at else "'" + str(v).replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"CASE CAST({key} AS BIGINT) % {len(values)} {arms} END"


TITLES = (
    "Compact Mini Projector", "Bamboo Kitchen Organizer: reusable storage", "Wireless Bluetooth Speaker",
    "Camping Lantern - Outdoor Light", "Sleep Pillow Deluxe", "World cup campaign plan", "Pet Feeder【Smart】",
    "Titanium Knife Set", "Coffee Service Subscription", "Designer Travel Backpack", "Software app for teams",
    "Massage Gun 小型ガジェット", "Lithium Power Station", "收納 Notebook Stationery", "Herbal Supplement Serum",
    "Large Wooden Furniture", "Workshop Course 體驗",
)
DESCRIPTIONS = (
    "A compact everyday carry tool made from recycled steel for outdoor and kitchen use.",
    "Short text.", "", "Wireless charging with bluetooth and wifi radio, tested by our studio.",
    "Online consulting service and membership for founders, monthly subscription with workshops.",
    "A minimalist household lamp that saves space and time, durable and easy to clean.",
    "Children love this toy robot; includes lithium battery pack and USB power bank.",
    "Medical grade therapy device with clinical diagnosis features for home wellness use.",
    "Premium wine and whisky glass set, hand crafted by a small family atelier since 1950.",
    "SaaS platform and mobile app for B2B teams; digital download only.",
    "生活雑貨とキャンプ用品。軽量で便利な収納ケースです。日本語の説明文がここに入ります。",
)
CATEGORIES = (
    "Design", "Kitchen", "Technology", " Outdoor ", "Games", "kitchen", "Pet Supplies", "x", "Fashion",
    "Food", "Design", "Health",
)
MAKERS = (
    "Studio Brand", "Sony", "Brand Works Corporation International Ltd", "x", "Nova Labs", "LG Electronics",
    "craft maker", "ACME Tools",
)

DOMAIN: dict[str, str] = {}

DOMAIN["part_sales"] = """
SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(16,2))) AS raised,
       COUNT(DISTINCT l_orderkey) AS n_orders, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
FROM {lineitem} GROUP BY l_partkey"""

_NAME = (
    "CASE WHEN p_partkey % 8 = 3 THEN NULL ELSE "
    + _pick("p_partkey", MAKERS)
    + " || CASE WHEN p_partkey % 8 IN (0, 4, 6) THEN ' ' || substr(p_brand, 7) ELSE '' END END"
)
_SITE = _pick("p_partkey + p_size", ("kickstarter", "indiegogo", "wadiz", "zeczec", "kickstarter", "other"))

DOMAIN["campaigns"] = f"""
SELECT CAST(p.p_partkey AS BIGINT) AS id, p_partkey, p_size, p_brand, p_name, p_retailprice,
  {_pick('p_partkey', TITLES)} || ' ' || p_name AS title,
  {_SITE} AS source_site,
  CASE WHEN p_partkey % 12 = 7 THEN NULL ELSE {_pick('p_partkey', CATEGORIES)} END AS category,
  {_pick('p_partkey + p_size', DESCRIPTIONS)} AS description,
  {_NAME} AS maker_name,
  CASE WHEN p_partkey % 13 = 5 THEN NULL
       ELSE CAST(p_retailprice * (10 + (p_partkey * 7) % 2500) AS DECIMAL(16,2)) END AS goal_amount,
  CASE WHEN p_partkey % 29 = 3 THEN NULL ELSE s.raised END AS raised_amount,
  CASE WHEN p_partkey % 31 = 4 THEN NULL ELSE s.n_orders * (1 + p_partkey % 37) END AS backers_count,
  CASE WHEN p_partkey % 7 = 2 THEN NULL ELSE CAST(s.first_ship AS DATE) END AS start_date,
  CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE CAST(s.last_ship AS DATE) END AS end_date,
  s.first_ship AS created_at, s.last_ship AS updated_at
FROM {{part}} p JOIN {{part_sales}} s ON p.p_partkey = s.l_partkey"""

_SLUG = "lower(substr(p_brand, 1, 5)) || substr(p_brand, 7)"
DOMAIN["projects"] = f"""
SELECT id, title, source_site, category, description, description AS description_clean, maker_name,
  CASE WHEN p_partkey % 11 = 6 THEN NULL
       WHEN p_partkey % 11 = 7 THEN 'https://example.com/projects/' || CAST(id AS VARCHAR(20))
       WHEN source_site = 'kickstarter' THEN 'https://www.kickstarter.com/projects/' || {_SLUG} || '/item-' || CAST(id AS VARCHAR(20))
       WHEN source_site = 'indiegogo' THEN 'https://www.indiegogo.com/en/projects/' || {_SLUG} || '/item-' || CAST(id AS VARCHAR(20)) || '?ref=top'
       WHEN source_site = 'wadiz' THEN 'https://www.wadiz.kr/web/campaign/detail/' || CAST(id AS VARCHAR(20)) || '/'
       ELSE 'https://www.zeczec.com/projects/p' || CAST(id AS VARCHAR(20)) END AS source_url,
  CASE CAST(p_partkey AS BIGINT) % 9
       WHEN 0 THEN NULL WHEN 1 THEN 'https://www.kickstarter.com/profile/' || {_SLUG}
       WHEN 2 THEN 'https://test.io/' WHEN 3 THEN 'ftp://files.' || {_SLUG} || '.com/'
       WHEN 4 THEN 'https://linktr.ee/' || {_SLUG}
       ELSE 'https://www.' || {_SLUG} || '.com/' || CASE WHEN p_partkey % 2 = 0 THEN 'shop' ELSE '' END END AS maker_url,
  CASE source_site WHEN 'wadiz' THEN 'KRW' WHEN 'zeczec' THEN 'TWD' ELSE 'USD' END AS currency,
  goal_amount, raised_amount, backers_count, start_date, end_date, created_at, updated_at,
  {_pick('p_partkey', ('new', 'reviewing', 'contacted', 'negotiating', 'won', 'rejected'))} AS status,
  {_pick('p_size + p_partkey', ('not_started', 'ready', 'contacted', 'awaiting_reply', 'replied', 'negotiating', 'contract_agreed', 'import_prep', 'jp_cf_prep', 'selling', 'rejected', 'closed', 'won', 'not_started', 'not_started', 'ready'))} AS sales_status,
  CASE WHEN p_partkey % 6 = 1 THEN NULL ELSE CAST((p_partkey * 37) % 101 AS INT) END AS latest_score,
  {_pick('p_partkey', ('high', 'mid', 'low', 'x'), null_at=(3,))} AS latest_recommendation,
  {_pick('p_partkey', ('clear', 'review', 'blocked', 'x', 'clear'), null_at=(3,))} AS lead_qualification_decision,
  {_pick('p_partkey', ('not_landed', 'possible', 'sold', 'x'), null_at=(3,))} AS latest_availability,
  CASE WHEN p_partkey % 19 = 8 THEN updated_at ELSE NULL END AS archived_at,
  CASE WHEN p_partkey % 19 = 8 THEN 'out of scope' ELSE NULL END AS archive_reason,
  CAST(NULL AS BIGINT) AS maker_id
FROM {{campaigns}} WHERE p_size <= 42"""

# parts with the largest sizes stand for domestic success cases
DOMAIN["success_cases"] = """
SELECT id, CASE WHEN p_partkey % 2 = 0 THEN 'makuake' ELSE 'greenfunding' END AS platform,
  title, category, goal_amount, raised_amount, backers_count, end_date, created_at, updated_at
FROM {campaigns} WHERE p_size > 42"""

def _owner(k: int) -> str:
    return f"CAST(l_partkey + CASE WHEN l_partkey % 7 = {k} THEN 1 ELSE 0 END AS BIGINT) AS project_id"


_SCORED = "CAST((l_orderkey * 8 + l_linenumber) * 1000003 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000003 AS BIGINT) AS id, l_shipdate AS created_at"
_HOST = "'brand' || CAST(1 + l_partkey % 25 AS VARCHAR(20))"
DOMAIN["contacts"] = f"""
SELECT {_owner(0)}, {_SCORED},
  CASE WHEN l_suppkey % 6 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE CAST(l_suppkey AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'sales@' || {_HOST} || '.com' WHEN 2 THEN ''
       WHEN 3 THEN NULL ELSE 'info@' || {_HOST} || '.com' END AS primary_email,
  CASE WHEN l_suppkey % 4 = 1 THEN 'https://' || {_HOST} || '.com/contact' ELSE NULL END AS primary_contact_form_url,
  CASE WHEN l_suppkey % 7 = 2 THEN 'https://www.instagram.com/' || {_HOST} ELSE NULL END AS instagram_url,
  CASE WHEN l_suppkey % 8 = 3 THEN 'https://www.linkedin.com/company/' || {_HOST} ELSE NULL END AS linkedin_url,
  CASE WHEN l_suppkey % 9 = 4 THEN 'https://www.facebook.com/' || {_HOST} ELSE NULL END AS facebook_url,
  CASE CAST(l_suppkey AS BIGINT) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://bit.ly/abc' WHEN 2 THEN 'https://www.kickstarter.com/profile/x'
       ELSE 'https://www.' || {_HOST} || '.com' END AS official_site_url,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_suppkey % 101 AS INT) END AS contactability_score,
  {_pick('l_suppkey', ('email', 'contact_form', 'press', 'x', 'instagram', 'manual_research'), null_at=(3,))} AS recommended_channel,
  CASE WHEN l_suppkey % 3 = 0 THEN 'bd@' || {_HOST} || '.com' ELSE NULL END AS found_email
FROM {{lineitem}}"""
DOMAIN["researches"] = f"""
SELECT {_owner(1)}, {_SCORED}, CASE WHEN l_linestatus = 'O' THEN 'completed' ELSE 'failed' END AS research_status,
  CASE WHEN l_suppkey % 2 = 0 THEN 'good fit' ELSE NULL END AS japan_market_fit
FROM {{lineitem}}"""
DOMAIN["drafts"] = f"SELECT {_owner(2)}, {_SCORED} FROM {{lineitem}}"
DOMAIN["activities"] = """
SELECT CAST(l_partkey + CASE WHEN l_partkey % 7 = 6 THEN 1 ELSE 0 END AS BIGINT) AS project_id, CAST((l_orderkey * 8 + l_linenumber) * 1000003 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000003 AS BIGINT) AS id, l_shipdate AS occurred_at
FROM {lineitem}"""
DOMAIN["assessments"] = f"""
SELECT {_owner(3)}, {_SCORED}, CAST((l_suppkey * 13) % 101 AS INT) AS japan_market_fit, CAST((l_suppkey * 29) % 101 AS INT) AS exclusivity,
  CAST((l_suppkey * 41) % 101 AS INT) AS makuake_fit, CAST((l_suppkey * 17) % 101 AS INT) AS overall_priority_score,
  CAST((l_suppkey * 7) % 101 AS INT) AS confidence, l_tax > 0.06 AS provisional
FROM {{lineitem}}"""
_CH = lambda k, n: _pick(f"l_suppkey + {n} * l_linenumber", ("found", "not_found", "limited", "not_found", "unknown", "not_found", "not_found"))
CHANNELS = ("amazon", "rakuten", "yahoo", "distributor", "subsidiary", "makuake", "greenfunding")
DOMAIN["japan_checks"] = (
    f"SELECT {_owner(4)}, {_SCORED}, CASE CAST(l_suppkey AS BIGINT) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status, "
    "CAST(1 + l_suppkey % 5 AS INT) AS sales_value_stars, "
    + ", ".join(f"{_CH(k, n)} AS ch_{k}" for n, k in enumerate(CHANNELS))
    + " FROM {lineitem}"
)
DOMAIN["jobs"] = f"""
SELECT {_owner(5)}, {_SCORED}, {_pick('l_suppkey', ('queued', 'running', 'completed', 'failed', 'completed'))} AS status,
  CASE WHEN l_suppkey % 2 = 0 THEN 'japan_sales_check' ELSE 'full_contact_intelligence' END AS job_type,
  l_shipdate AS started_at, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_shipdate END AS heartbeat_at,
  CASE WHEN l_suppkey % 5 IN (2, 3, 4) THEN l_shipdate ELSE NULL END AS finished_at
FROM {{lineitem}}"""
# signs of life of jobs: the start, and the newest one some time after it
DOMAIN["beats"] = """
SELECT id AS job_id, project_id, 'running' AS status, created_at AS seen_at FROM {jobs} WHERE status <> 'queued'
UNION ALL
SELECT id AS job_id, project_id, status, coalesce(heartbeat_at, started_at, created_at) + (INTERVAL '40' SECOND) * CAST(id % 5 AS INT) AS seen_at FROM {jobs} WHERE status <> 'queued'"""
DOMAIN["people"] = f"""
SELECT {_owner(6)}, {_SCORED}, s_name AS name, {_pick('l_suppkey', ('CEO', 'Head of Partnerships', 'Customer Support', 'Marketing Manager'))} AS title,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST((l_suppkey * 11) % 101 AS INT) END AS priority, CAST((l_suppkey * 3) % 101 AS INT) AS confidence
FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey"""
DOMAIN["outreach"] = f"""
SELECT {_owner(0)}, {_SCORED}, {_pick('l_suppkey', ('draft', 'sent', 'sent', 'replied', 'negotiating', 'contract', 'lost', 'sent'))} AS outreach_status,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_shipdate END AS generated_at,
  CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE l_shipdate END AS sent_at,
  CASE WHEN l_suppkey % 11 = 5 THEN NULL ELSE l_shipdate + INTERVAL '7' DAY END AS followup_due_at,
  CAST(l_suppkey % 4 AS INT) AS followup_count
FROM {{lineitem}}"""
DOMAIN["opportunities"] = f"""
SELECT CAST((l_orderkey * 8 + l_linenumber) * 1000003 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000003 AS BIGINT) AS id, l_shipdate AS created_at,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST((l_orderkey * 8 + l_linenumber) * 1000003 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000003 AS BIGINT) END AS contact_discovery_id,
  {_pick('l_suppkey', ('not_started', 'in_progress', 'contacted', 'won', 'lost'))} AS status,
  {_pick('l_suppkey', ('high', 'medium', 'low'))} AS sales_priority, CAST((l_suppkey * 19) % 101 AS INT) AS sales_score,
  CASE WHEN l_suppkey % 4 = 2 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS next_action_due_date
FROM {{lineitem}}"""
DOMAIN["makers"] = f"""
SELECT CAST(s_suppkey + 1 AS BIGINT) AS id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Nova Labs ' || CAST(s_suppkey % 25 AS VARCHAR(20)) ELSE s_name END AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.brand' || CAST(1 + s_suppkey % 25 AS VARCHAR(20)) || '.com/' ELSE NULL END AS website_url,
  {_pick('s_suppkey', ('lead', 'contacted', 'negotiating', 'won', 'lost'))} AS status,
  'call ' || n_name AS next_action,
  CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE CAST(TIMESTAMP '2000-06-01 00:00:00' + INTERVAL '1' DAY * CAST(s_suppkey % 40 AS INT) AS DATE) END AS next_action_date,
  TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey AS INT) AS updated_at
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey"""

_EK = "CAST(floor(value * 100) AS BIGINT)"
# one site whose pages have changed: nearly all its runs fail
_BROKEN = "(user_id % 6 = 4 AND event_id % 40 <> 0)"
DOMAIN["scrape_runs"] = f"""
SELECT event_id AS id, {_pick('user_id', ('kickstarter', 'indiegogo', 'wadiz', 'zeczec', 'makuake', 'unknown_site'))} AS site,
  CASE WHEN {_BROKEN} OR event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'error'
       WHEN event_type = 'view' AND user_id % 9 = 0 THEN 'running' ELSE 'success' END AS status,
  CAST(floor(event_id / 7) AS BIGINT) AS job_run_id,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN NULL WHEN {_EK} % 3 = 0 THEN 'HTTP 403 Forbidden' ELSE 'selector missing' END AS error,
  CASE WHEN {_BROKEN} THEN 'structure' WHEN event_type NOT IN ('error', 'signup') THEN NULL ELSE {_pick(_EK, ('network', 'structure', 'unknown', 'x'), null_at=(3,))} END AS error_kind,
  ts AS started_at, CASE WHEN user_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '30' SECOND END AS finished_at
FROM {{events}}"""
DOMAIN["status_events"] = f"""
SELECT event_id AS id, user_id AS project_id, ts AS created_at,
  {_pick('event_id + user_id', ('ready', 'contacted', 'awaiting_reply', 'replied', 'negotiating', 'won', 'import_prep', 'selling', 'closed', 'rejected', 'not_started'))} AS to_status
FROM {{events}}"""
DOMAIN["usage_logs"] = f"""
SELECT event_id AS id, event_type AS kind, ts AS created_at, CAST({_EK} % 4000 AS BIGINT) AS input_tokens,
  CAST({_EK} % 900 AS BIGINT) AS output_tokens, CAST(value AS DECIMAL(12,6)) AS cost_usd
FROM {{events}}"""
DOMAIN["availability_checks"] = "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS project_id, o_orderdate AS created_at FROM {orders}"
DOMAIN["availability_hits"] = f"""
SELECT CAST((l_orderkey * 8 + l_linenumber) * 1000003 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 1000003 AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS check_id,
  {_pick('l_suppkey', ('amazon', 'rakuten', 'yahoo', 'makuake', 'greenfunding'))} AS site, CAST((l_partkey * 7) % 101 AS INT) AS match_score
FROM {{lineitem}}"""


_NOW = f"TIMESTAMP '{AS_OF}'"
_BRAND_SITE = "'https://www.brand' || CAST(1 + id % 25 AS VARCHAR(20)) || '.com/'"
DOMAIN["lead_facts"] = f"""
SELECT id AS project_id, title, description, category, maker_name, source_url, source_site, end_date, created_at, updated_at,
  CASE WHEN id % 10 = 9 THEN 'short' ELSE title || ': summary of the product' END AS japanese_summary,
  CASE WHEN id % 8 = 5 THEN NULL ELSE CAST((id * 23) % 101 AS INT) END AS fit,
  CASE WHEN id % 4 = 1 THEN NULL ELSE {_BRAND_SITE} END AS official_url, id % 4 = 2 AS official_verified, id % 3 = 0 AS identity_verified,
  {_pick('id', ('x', 'distributor', 'maker_official', 'unknown', 'retailer', 'agency', 'maker_official'), null_at=(0,))} AS creator_class,
  'https://seller' || CAST(id % 40 AS VARCHAR(20)) || '.com/' AS creator_url,
  CASE WHEN id % 2 = 0 THEN created_at ELSE updated_at END AS creator_checked,
  CASE WHEN id % 17 = 3 THEN 'https://oem.page/' ELSE NULL END AS oem_url,
  CASE WHEN id % 11 = 1 THEN 1 ELSE 0 END AS n_cf, CAST(id % 4 AS INT) AS n_other, CAST(id % 6 AS INT) AS n_global,
  {_NOW} - INTERVAL '1' DAY * CAST(id % 500 AS INT) AS listing_checked,
  CASE WHEN id % 23 = 7 THEN 'https://gone.page/' ELSE NULL END AS gone_url, {_NOW} - INTERVAL '1' DAY * CAST(id % 13 AS INT) AS gone_checked,
  CASE WHEN id % 5 = 0 THEN 'not_checked' ELSE 'completed' END AS japan_status,
  {_pick('id', ('x', 'sold_in_japan', 'not_found_in_japan', 'inconclusive', 'not_found_in_japan'), null_at=(0,))} AS japan_result,
  CASE WHEN id % 2 = 0 THEN 'https://www.amazon.co.jp/s' ELSE NULL END AS japan_url, {_NOW} - INTERVAL '1' DAY * CAST(id % 200 AS INT) AS japan_checked,
  CASE WHEN id % 3 = 1 THEN 'info@brand' || CAST(1 + id % 25 AS VARCHAR(20)) || '.com' ELSE NULL END AS email,
  CASE WHEN id % 6 = 4 THEN NULL ELSE {_BRAND_SITE} END AS email_source,
  CASE WHEN id % 5 = 2 THEN 'Jane Doe' ELSE NULL END AS person
FROM {{projects}}"""


# --- pages of maker sites: the raw page plus a contact block; seven pages to a site ---
_SITE_KEY = "CAST(floor(page_id / 7) AS BIGINT)"
_BRAND = "'brand' || CAST(1 + project_id % 25 AS VARCHAR(20))"
BLOCKS = (
    "'<footer><a href=\"mailto:Sales@' || brand || '.com?subject=hi\">mail</a></footer>'",
    "'<p>contact info@' || brand || '.com or support@kickstarter.com</p>'",
    "'<p>partner [at] ' || brand || ' [dot] com</p>'",
    "'<script>var e = \"hello\" + \"@\" + \"' || brand || '.com\";</script>'",
    "'<a data-cfemail=\"4231232e2731022f232927306c212d2f\">x</a>'",
    "'noreply@' || brand || '.com jane.doe@gmail.com <a href=\"https://www.instagram.com/' || brand || '/\">ig</a><a href=\"https://twitter.com/intent/tweet?u=1\">share</a>'",
    "'<a href=\"../docs/Catalog-2024.pdf\">PDF</a> <a href=\"https://facebook.com/kickstarter\">fb</a> <a href=\"//shop.' || brand || '.com/a/./b/../c?x=1#top\">Visit our website</a>'",
    "'Press and Influencers | ethan@' || brand || '.com | Reseller: sales@' || brand || '.com'",
    "'<script type=\"application/ld+json\">{{\"@type\":\"Organization\",\"name\":\"Brand Works\",\"email\":\"ld@' || brand || '.com\",\"sameAs\":[\"https://www.linkedin.com/company/' || brand || '\"]}}</script>'",
    "'<p>Jane Miller, CEO and Tom Hardy - Head of Sales</p><p>Contact Team, Manager</p> jane@' || brand || '.com'",
    "'logo@2x.png hi@example.com 24c0ffee24c0ffee24c0ffee24@o1.ingest.sentry.io wholesale@' || brand || '.com'",
)
DOMAIN["crawl_pages"] = f"""
SELECT project_id, page_id, position, variant,
  'https://www.' || brand || '.com' || CASE position WHEN 0 THEN '/' WHEN 1 THEN '/pages/contact' WHEN 2 THEN '/about-us' WHEN 3 THEN '/privacy-policy' WHEN 4 THEN '/press/kit' WHEN 5 THEN '/wholesale' ELSE '/products/item' END AS url,
  brand || '.com' AS site_host,
  html || CASE variant {' '.join(f"WHEN {i} THEN {b}" for i, b in enumerate(BLOCKS))} ELSE '' END AS html
FROM (SELECT {_SITE_KEY} AS project_id, page_id, CAST(page_id % 7 AS INT) AS position, CAST((page_id * 5 + 2 * {_SITE_KEY}) % 12 AS INT) AS variant,
  'brand' || CAST(1 + {_SITE_KEY} % 25 AS VARCHAR(20)) AS brand, html FROM {{pages}}) t"""
DOMAIN["crawl_projects"] = """
SELECT project_id AS id, 'Brand Works ' || CAST(project_id AS VARCHAR(20)) AS title, CASE WHEN project_id % 3 = 0 THEN 'Brand Works' ELSE site_host END AS maker_name,
  CASE project_id % 4 WHEN 0 THEN 'kickstarter' WHEN 1 THEN 'wadiz' WHEN 2 THEN 'zeczec' ELSE 'indiegogo' END AS source_site,
  CASE WHEN project_id % 5 = 4 THEN NULL ELSE 'https://www.' || site_host || '/' END AS maker_url
FROM (SELECT DISTINCT project_id, site_host FROM {crawl_pages}) t"""

# --- candidate hosts and search results, one per event ---------------------------------
HOSTS = (
    "www.brandworks.com", "shopee.tw", "www.amazon.co.jp", "brandx.com", "x.com", "news.site.jp", "blog.naver.com",
    "sub.brandworks.com", "lg.com", "brandworks.vercel.app", "brandworks.myshopify.com", "www.nih.gov", "reurl.cc", "ideafound.com",
    "mail.makerz.co.kr", "shop.unionchen.com.tw", "test.io", "www.kickstarter.com", "instagram.com", "linkedin.com", "www.facebook.com",
    "wholesale.brandworks.co.uk", "example.com", "gmail.com", "127.0.0.1",
)
PATHS = ("", "/", "/contact", "/pages/contact", "/about", "/brandworks/", "/company/brandworks", "/in/jane", "/p/abc", "/cart", "/projects/example", "/support/faq?x=1#a", "/press", "/wholesale")
DOMAIN["results"] = f"""
SELECT event_id AS id, user_id AS project_id, CAST(event_id % 20 AS INT) AS position,
  CASE WHEN event_id % 41 = 0 THEN 'ftp' WHEN event_id % 43 = 0 THEN 'http' ELSE 'https' END || '://' || {_pick('event_id', HOSTS)} || {_pick('event_id + user_id', PATHS)} AS url,
  {_pick('event_id + 2 * user_id', ('Brandworks official site', 'Review of the lamp', 'Buy now', 'Aurora lamp by Brandworks', 'Brandworks | Big Retailer', ''))} AS title,
  {_pick('event_id', ('the aurora lamp', 'nothing here', 'brandworks makes lamps'))} AS snippet,
  {_pick('user_id', ('Brandworks', 'Jane Wilson', 'Nova Labs', 'x', 'LG'), null_at=(3,))} AS maker_name,
  CASE WHEN user_id % 4 = 0 THEN 'brandworks.com' ELSE NULL END AS official_domain
FROM {{events}}"""
LOCALS = (
    "sales", "info", "support", "careers", "noreply", "jane.doe", "bd", "contact-us", "press", "privacy", "test", "hello2",
    "postmaster", "24c0ffee24c0ffee24c0ffee24", "global", "career", "care", "abc123def456ghi789jkl0123456",
)
EMAIL_HOSTS = (
    "brandworks.com", "mail.brandworks.com", "gmail.com", "kickstarter.com", "ideafound.com", "example.com", "www.brandworks.com",
    "bit.ly", "lg.com", "makerz.co.kr", "logo.png", "novalabs.co", "sentry.io", "backerkit.com", "unknown-shop.net",
)
DOMAIN["addresses"] = f"""
SELECT event_id AS id, user_id AS project_id, CAST(event_id % 11 AS INT) AS position, {_pick('event_id', LOCALS)} || '@' || {_pick('event_id + user_id', EMAIL_HOSTS)} AS email,
  {_pick('user_id', ('Brandworks', 'Jane Wilson', 'Nova Labs', 'x', 'LG'), null_at=(3,))} AS maker_name,
  CASE WHEN user_id % 4 = 0 THEN 'brandworks.com' ELSE NULL END AS official_domain,
  CASE WHEN user_id % 3 = 0 THEN 'kickstarter.com' WHEN user_id % 3 = 1 THEN 'backerkit.com' ELSE NULL END AS site_domain,
  {_pick('event_id', ('Press & Influencers', 'Reseller', 'x', 'Customer Service', 'General Inquiry', 'x', '채용'), null_at=(2, 5))} AS label,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 100 AS INT) END AS score,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE 'https://www.brandworks.com/' || {_pick('event_id', ('contact', 'about-us', 'privacy', 'products', 'legal/terms'))} END AS source_url
FROM {{events}}"""
DOMAIN["replies"] = f"""
SELECT conv_id, turn, text || ' ' || {_pick('conv_id * 3 + turn', ('We are interested, sounds great.', 'Not interested, thanks.', 'Please send more information and a sample.', 'What is the price and MOQ?', 'Let us schedule a call.', 'We already have a distributor.', 'OK.', '興味があります。', 'Unfortunately too high a problem.'))} AS body
FROM {{conversations}} WHERE role = 'user'"""


# --- labelled evaluation cases: predictions against expectations, one per project ---------
DOMAIN["label_cases"] = f"""
SELECT id AS project_id, source_site,
  {_pick('id', ('verified', 'verified', 'partially_verified', 'blocked', 'unresolved'))} AS verification_status,
  'info@brand' || CAST(id % 9 AS VARCHAR(20)) || '.com' AS expected_email, CASE WHEN id % 5 = 0 THEN 'hi@brand' || CAST(id % 9 AS VARCHAR(20)) || '.com' ELSE NULL END AS plausible_email,
  CASE WHEN id % 6 = 0 THEN 'hi@ideafound.com' ELSE NULL END AS fallback_email,
  CASE WHEN id % 4 = 0 THEN 'x@other.net' WHEN id % 4 = 1 THEN 'INFO@brand' || CAST(id % 9 AS VARCHAR(20)) || '.com' WHEN id % 4 = 2 THEN 'help@kickstarter.com' ELSE NULL END AS saved_email,
  CASE WHEN id % 5 = 0 THEN 'hi@brand' || CAST(id % 9 AS VARCHAR(20)) || '.com' WHEN id % 5 = 1 THEN 'a@ideafound.com' ELSE NULL END AS saved_email2,
  CASE WHEN id % 7 = 3 THEN NULL ELSE 'https://www.brand' || CAST(id % 9 AS VARCHAR(20)) || '.com/' END AS expected_site,
  CASE WHEN id % 3 = 0 THEN 'https://shop.brand' || CAST(id % 9 AS VARCHAR(20)) || '.com/x' WHEN id % 3 = 1 THEN 'https://reseller.net' ELSE NULL END AS saved_site,
  CASE WHEN id % 2 = 0 THEN 'Jane Miller' ELSE 'Tom Hardy' END AS expected_person, CASE WHEN id % 4 < 2 THEN 'CEO' ELSE 'Sales Director' END AS expected_role,
  CASE WHEN id % 3 = 0 THEN 'jane  miller' WHEN id % 3 = 1 THEN 'Tom Hardy' ELSE NULL END AS saved_person, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 < 3 THEN 'President' ELSE 'sales' END AS saved_role,
  CASE id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'review' ELSE 'clear' END AS expected_pre_research, CASE id % 3 WHEN 0 THEN 'blocked' ELSE 'review' END AS expected_pre_outreach,
  CASE WHEN id % 5 = 0 THEN NULL ELSE id % 2 = 0 END AS should_research, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 3 = 1 END AS should_allow_outreach, id % 4 <> 3 AS evidence_sufficient,
  {_pick('id', ('confirmed', 'none', 'x', 'ambiguous', 'wrong', 'excluded'), null_at=(2,))} AS gt_status, {_pick('id', ('legal_company_page', 'x', 'magic'), null_at=(1,))} AS evidence_type,
  CASE WHEN id % 8 = 1 THEN 'mail me at a@b.com' WHEN id % 8 = 2 THEN 'token: abc' WHEN id % 8 = 3 THEN 'call +81 90-1234-5678' WHEN id % 8 = 4 THEN '' ELSE 'checked page' END AS reviewer_note,
  {_pick('id', ('high', 'x', 'sure'), null_at=(1,))} AS confidence, CASE WHEN id % 10 = 0 THEN 'http://192.168.1.1/' WHEN id % 10 = 1 THEN 'a@b.com' WHEN id % 10 = 2 THEN 'brand.co.jp/x' WHEN id % 10 = 3 THEN NULL ELSE 'https://www.brand.com' END AS gt_official_url,
  CASE WHEN id % 4 = 0 THEN 'brand.com' ELSE NULL END AS gt_registered_domain
FROM {{projects}}"""
DOMAIN["contact_layers"] = f"""
SELECT user_id AS project_id, CAST(event_id % 6 AS INT) AS layer_rank, {_pick('event_id', ('email', 'site', 'form', 'social', 'person', 'evidence', 'evidence'))} AS kind,
  CASE WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 2 = 0 THEN 'Value' || CAST(event_id % 60 AS VARCHAR(20)) ELSE 'value' || CAST(event_id % 60 AS VARCHAR(20)) END AS value
FROM {{events}}"""
DOMAIN["key_edges"] = """
SELECT CAST(l_orderkey AS BIGINT) AS id, 'p:' || CAST(l_partkey AS VARCHAR(20)) AS k FROM {lineitem}"""


def _references(text: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(text) if f))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or domain table as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    text = DOMAIN[name]
    return spark.sql(text, **{r: table(spark, sf_dir, r) for r in _references(text)})


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _closure(name: str, seen: dict[str, str]) -> None:
    if name in BASE_TABLES or name in seen:
        return
    for r in _references(DOMAIN[name]):
        _closure(r, seen)
    seen[name] = DOMAIN[name].format(**{r: r for r in _references(DOMAIN[name])})


def with_tables(*names: str, then: str) -> str:
    """SQL text over domain tables, for engines that only know the base tables.

    ``then`` is a SELECT, or ``WITH`` clauses of its own followed by a SELECT.
    """
    seen: dict[str, str] = {}
    for n in names:
        _closure(n, seen)
    head = ",\n".join(f"{k} AS (\n{v}\n)" for k, v in seen.items())
    body = then.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"

"""Gates, qualification, entity selection and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.catalog import inputs, query
from leadloom.catalog.boards import any_in, cats
from leadloom.catalog.inputs import joined
from leadloom.catalog.lists import NOW, q
from leadloom.catalog.pages import REASON, net, upath
from leadloom.domain import AS_OF, table, with_tables
from leadloom.functions import urls
from leadloom.functions.text import joined_lower
from leadloom.operators import gates

HOST = "regexp_extract(lower(source_url), '^https?://([^/?#]*)', 1)"
CAMPAIGN_SQL = (
    "CASE WHEN " + " OR ".join(f"(source_site = '{s}' AND ({HOST} = '{d}' OR {HOST} LIKE '%.{d}'))" for s, d in vocab.CAMPAIGN_DOMAINS.items()) + " THEN source_url END"
)


def term(text: str, terms) -> str:
    """SQL twin of the word-boundary match, without look-behind."""
    latin = [t for t in terms if any("a" <= c <= "z" for c in t)]
    other = [t for t in terms if t not in latin]
    tests = []
    if latin:
        body = "|".join(t.replace("-", "[-]").replace("'", "''") for t in latin)
        tests.append(f"regexp_matches({text}, '(^|[^a-z0-9])(?:{body})($|[^a-z0-9])')")
    if other:
        tests.append(any_in(text, other))
    return "(" + " OR ".join(tests) + ")"


@query(
    "score11_regulatory_checks",
    with_tables("projects", then="WITH t AS (SELECT id, lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(category, ''))) AS txt FROM projects) SELECT id, concat_ws(',', "
                + ", ".join(f"CASE WHEN {any_in('txt', w)} THEN '{k}' END" for k, w in vocab.REGULATORY_CHECKS.items()) + ") AS items FROM t"),
)
def score11(spark, sf):
    rows = inputs.projects(spark, sf).select("id", joined_lower(F.col("title"), F.col("description"), F.col("category")).alias("t"))
    return rows.select("id", F.array_join(F.transform(gates.regulatory_checks(F.col("t")), lambda x: x["item"]), ",").alias("items"))


GATE_TEXT = f"""g0 AS (SELECT f.*, {CAMPAIGN_SQL} AS page, lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(category, ''))) AS txt FROM lead_facts f),
g1 AS (SELECT *, {cats('txt', vocab.CAUTION_CATEGORIES)} AS ca, {term('txt', vocab.NON_PHYSICAL_STRONG)} OR ({term('txt', vocab.NON_PHYSICAL_WEAK)} AND NOT {term('txt', vocab.PHYSICAL_HINTS)}) AS virtual_only FROM g0),
g2 AS (SELECT *, page IS NULL AS no_page, length(japanese_summary) < 20 AS no_summary,
  list_filter([CASE WHEN page IS NULL THEN 'no_campaign_url' END, CASE WHEN length(japanese_summary) < 20 THEN 'no_summary' END, CASE WHEN virtual_only THEN 'non_physical' END, CASE WHEN {any_in('txt', vocab.B2B_HINTS)} THEN 'b2b' END,
    CASE WHEN {any_in('txt', vocab.BULKY_HINTS)} THEN 'bulky' END, CASE WHEN {any_in('txt', vocab.MEDICAL_CLAIM_HINTS)} THEN 'medical_claim' END, CASE WHEN {any_in('txt', vocab.DANGEROUS_HINTS)} THEN 'dangerous' END,
    CASE WHEN list_has_any(ca, [{q(vocab.HEAVY_REGULATION)}]) THEN 'heavy_regulation' END,
    CASE WHEN len({cats('txt', vocab.APPEAL_HINTS)}) = 0 AND len({cats('txt', vocab.HIGH_FIT_CATEGORIES)}) = 0 THEN 'no_appeal' END], lambda x: x IS NOT NULL) AS blockers FROM g1),
g3 AS (SELECT *, CASE WHEN no_page OR no_summary THEN 'not_eligible' WHEN len(blockers) > 0 OR fit IS NULL THEN 'needs_review' WHEN fit >= 45 THEN 'eligible' WHEN fit >= 30 THEN 'needs_review' ELSE 'not_eligible' END AS gate_decision FROM g2)"""


def lead_facts(spark, sf):
    rows = table(spark, sf, "lead_facts")
    return rows.withColumn("campaign_url", urls.campaign_url(F.col("source_url"), F.col("source_site")))


@query("gate01_contact_gate", with_tables("lead_facts", then=f"WITH {GATE_TEXT} SELECT project_id, gate_decision, array_to_string(blockers, ',') AS gate_blockers FROM g3"))
def gate01(spark, sf):
    rows = gates.contact_search_gate(lead_facts(spark, sf).withColumn("makuake_fit", F.col("fit")))
    return rows.select("project_id", "gate_decision", joined("gate_blockers"))


def lead_signals(spark, sf):
    """The nested signals row from flat facts."""
    c = F.col
    pages = lambda n, tag: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: i <= n),
        lambda i: F.struct(F.concat(F.lit(f"https://{tag}"), i.cast("string"), F.lit(".shop/p")).alias("url"), c("listing_checked").alias("checked_at"), F.lit("page_fetch").alias("method"), F.lit(None).cast("string").alias("excerpt")),
    )
    notice = lambda url, at, note: F.struct(url.alias("source_url"), at.alias("checked_at"), F.lit("page_fetch").alias("method"), F.lit(note).alias("excerpt"))
    channel = F.struct(F.lit("amazon").alias("channel"), F.lit("Amazon").alias("label"), F.lit("found").alias("status"), c("japan_url").alias("search_url"), F.lit("").alias("note"))
    return lead_facts(spark, sf).withColumns(
        {
            "official_site": F.struct(c("official_url").alias("url"), c("official_verified").alias("verified"), F.lit(None).cast("string").alias("source_url"), c("updated_at").alias("checked_at"), F.lit("page_fetch").alias("method")),
            "maker_identity": F.struct(c("identity_verified").alias("verified"), c("official_url").alias("source_url"), c("updated_at").alias("checked_at"), F.lit("page_fetch").alias("method")),
            "creator_domain": F.struct(c("creator_url").alias("url"), c("creator_class").alias("ownership_class"), c("creator_checked").alias("checked_at"), F.lit(None).cast("string").alias("method")),
            "japan_sales": F.struct(c("japan_status").alias("status"), c("japan_result").alias("result"), F.array_compact(F.array(c("japan_url"))).alias("source_urls"), c("japan_checked").alias("checked_at"), F.array(channel).alias("channels")),
            "japan_cf_listings": pages(c("n_cf"), "cf"),
            "other_brand_listings": pages(c("n_other"), "other"),
            "global_listings": pages(c("n_global"), "world"),
            "oem_notice": notice(c("oem_url"), c("updated_at"), "OEM ready"),
            "discontinued_notice": notice(c("gone_url"), c("gone_checked"), "discontinued"),
            "business_emails": F.array(F.struct(c("email"), c("email_source").alias("source_url"), c("updated_at").alias("checked_at"), F.lit("mailto").alias("method"), F.lit("mid").alias("role"))),
            "decision_makers": F.array(F.struct(c("person").alias("name"), c("official_url").alias("source_url"), c("updated_at").alias("checked_at"), F.lit("page_fetch").alias("method"))),
        }
    )




def qualification_sql(stage: str) -> str:
    e = stage == "pre_research"
    sv = lambda a, b: f"'{a}'" if e else f"'{b}'"
    fresh = lambda at, days: f"({at} >= {NOW} - INTERVAL {days} DAY)"
    reg = {k: f"list_has_any(ca, [{q(v)}])" for k, v in vocab.QUALIFY_REGULATED.items()}
    blocker = lambda cond, proof: f"CASE WHEN {cond} THEN CASE WHEN {proof} THEN 'blocker' ELSE 'review' END"
    listing_ok = lambda code_days: f"({fresh('listing_checked', code_days)})"
    sev = {
        "A": f"CASE WHEN list_has_any(ca, [{q(vocab.HEAVY_REGULATION)}]) OR {term('txt', vocab.BULKY_HINTS)} THEN {sv('review', 'info')} ELSE 'info' END",
        "B": (blocker("n_cf > 0", listing_ok(365)) if e else "CASE WHEN n_cf > 0 THEN 'info'") + f" WHEN {term('txt', vocab.QUALIFY_NON_PRODUCT)} THEN {sv('review', 'info')} ELSE 'info' END",
        "C": "CASE WHEN oem_url IS NOT NULL OR n_other >= 2 THEN 'review' ELSE 'info' END",
        "D": f"CASE WHEN creator_class IS NULL THEN {sv('info', 'review')} WHEN creator_class IN ('distributor', 'retailer', 'agency') THEN " + ("'review'" if e else f"CASE WHEN {fresh('creator_checked', 365)} THEN 'blocker' ELSE 'review' END") + " ELSE 'info' END",
        "E": "CASE WHEN identity_verified THEN 'info' " + ("WHEN trim(coalesce(maker_name, '')) = '' THEN 'review' ELSE 'info' END" if e else "ELSE 'blocker' END"),
        "F": f"CASE WHEN japan_result = 'sold_in_japan' AND japan_url IS NOT NULL AND {fresh('japan_checked', 90)} THEN 'blocker' WHEN japan_result = 'sold_in_japan' THEN 'review' ELSE 'info' END",
        "G": "'info'",
        **{k: f"CASE WHEN {reg[k]} THEN {sv('review', 'info')} ELSE 'info' END" for k in "HIJKL"},
        "M": f"CASE WHEN {reg['K']} THEN {sv('review', 'info')} ELSE 'info' END",
        **{k: f"CASE WHEN {term('txt', vocab.QUALIFY_STRONG[k])} THEN CASE WHEN page IS NOT NULL THEN 'blocker' ELSE 'review' END WHEN {term('txt', vocab.QUALIFY_WEAK[k])} AND NOT {term('txt', vocab.PHYSICAL_HINTS)} THEN 'review' ELSE 'info' END" for k in "NOP"},
        "Q": (f"CASE WHEN gone_url IS NOT NULL THEN CASE WHEN {fresh('gone_checked', 7)} THEN 'blocker' ELSE 'review' END" if e else "CASE WHEN gone_url IS NOT NULL THEN 'review'")
        + f" WHEN end_date < {NOW} AND official_url IS NULL THEN 'review' ELSE 'info' END",
        "R": (blocker("n_global >= 3", listing_ok(90)) if e else "CASE WHEN n_global >= 3 THEN 'info'") + f" WHEN coalesce({term('lower(maker_name)', vocab.QUALIFY_MEGA_BRANDS)}, false) THEN {sv('review', 'info')} ELSE 'info' END",
        "S": "CASE WHEN official_verified AND official_url IS NOT NULL THEN 'info' " + ("WHEN official_url IS NULL THEN 'info' ELSE 'review' END" if e else "ELSE 'review' END"),
        "T": "CASE WHEN page IS NULL OR length(trim(japanese_summary)) < 20 THEN 'blocker' ELSE 'info' END",
    }
    pairs = ", ".join(f"{{'code': '{k}', 'sev': {v}}}" for k, v in sev.items())
    pick = lambda s: f"array_to_string(list_transform(list_filter(fs, lambda f: f.sev = '{s}'), lambda f: f.code), ',')"
    return f"""WITH {GATE_TEXT}, w AS (SELECT project_id, [{pairs}] AS fs FROM g1),
    v AS (SELECT project_id, {pick('blocker')} AS blocker_codes, {pick('review')} AS review_codes FROM w)
    SELECT project_id, CASE WHEN blocker_codes <> '' THEN 'blocked' WHEN review_codes <> '' THEN 'review' ELSE 'clear' END AS decision, blocker_codes, review_codes FROM v"""


def _qualified(spark, sf, stage):
    rows = gates.qualify(lead_signals(spark, sf), stage, AS_OF)
    return rows.select("project_id", "decision", joined("blocker_codes"), joined("review_codes"))


@query("gate03_qualify_pre_research", with_tables("lead_facts", then=qualification_sql("pre_research")))
def gate03a(spark, sf):
    return _qualified(spark, sf, "pre_research")


@query("gate03_qualify_pre_outreach", with_tables("lead_facts", then=qualification_sql("pre_outreach")))
def gate03b(spark, sf):
    return _qualified(spark, sf, "pre_outreach")




@query(
    "gate05_positive_facts",
    with_tables("lead_facts", then=f"""WITH {GATE_TEXT}
    SELECT project_id, concat_ws(',', CASE WHEN page IS NOT NULL THEN 'campaign_url_verified' END,
      CASE WHEN page IS NOT NULL AND {term('txt', vocab.PHYSICAL_HINTS)} AND NOT ({' OR '.join(term('txt', vocab.QUALIFY_STRONG[k]) for k in 'NOP')}) THEN 'physical_product_confirmed' END,
      CASE WHEN trim(coalesce(maker_name, '')) <> '' THEN 'maker_name_present' END, CASE WHEN official_verified AND official_url IS NOT NULL THEN 'official_site_verified' END,
      CASE WHEN identity_verified AND official_url IS NOT NULL THEN 'maker_identity_verified' END, CASE WHEN email IS NOT NULL AND email_source IS NOT NULL THEN 'business_contact_found' END,
      CASE WHEN person IS NOT NULL AND official_url IS NOT NULL THEN 'decision_maker_found' END, CASE WHEN japan_status = 'completed' AND japan_url IS NOT NULL AND japan_checked IS NOT NULL THEN 'japan_sales_check_completed' END) AS facts FROM g1"""),
)
def gate05(spark, sf):
    rows = gates.qualify(lead_signals(spark, sf), "pre_research", AS_OF)
    return rows.select("project_id", F.array_join(F.transform("positive_facts", lambda f: f["key"]), ",").alias("facts"))


@query("gate04_downgraded_findings")
def gate04(spark, sf):
    rows = gates.findings_table(gates.qualify(lead_signals(spark, sf), "pre_outreach", AS_OF))
    return rows.filter(F.col("downgrade_reason").isNotNull()).select("project_id", "code", "verdict", "severity", "downgraded_from", "downgrade_reason")


@query(
    "gate02_merged_gate",
    with_tables("lead_facts", then=f"""WITH {qualification_sql('pre_research').split('SELECT project_id, CASE WHEN')[0].strip().removeprefix('WITH ')},
    qd AS (SELECT project_id, CASE WHEN blocker_codes <> '' THEN 'blocked' WHEN review_codes <> '' THEN 'review' ELSE 'clear' END AS decision FROM v)
    SELECT g3.project_id, CASE WHEN decision = 'blocked' THEN 'not_eligible' ELSE gate_decision END AS gate_decision, decision <> 'blocked' AND gate_decision = 'eligible' AS eligible FROM g3 JOIN qd ON g3.project_id = qd.project_id"""),
)
def gate02(spark, sf):
    rows = gates.qualify(gates.contact_search_gate(lead_signals(spark, sf).withColumn("makuake_fit", F.col("fit"))), "pre_research", AS_OF)
    heavy = F.when(F.col("decision") == "blocked", F.col("blocker_codes")).otherwise(F.col("review_codes"))
    merged = gates.merge_gate(F.col("gate_decision"), F.col("gate_reasons"), F.col("decision"), heavy)
    return rows.select("project_id", merged["gate_decision"].alias("gate_decision"), merged["eligible"].alias("eligible"))


@query(
    "gate06_override_history",
    with_tables("lead_facts", then=f"""{qualification_sql('pre_outreach').rstrip()}"""
                .replace("SELECT project_id, CASE WHEN blocker_codes <> '' THEN 'blocked' WHEN review_codes <> '' THEN 'review' ELSE 'clear' END AS decision, blocker_codes, review_codes FROM v",
                         "SELECT v.project_id, CASE WHEN official_verified THEN 'clear' WHEN blocker_codes <> '' THEN 'blocked' WHEN review_codes <> '' THEN 'review' ELSE 'clear' END AS decision, "
                         "CASE WHEN blocker_codes <> '' THEN 'blocked' WHEN review_codes <> '' THEN 'review' ELSE 'clear' END AS machine_decision, blocker_codes FROM v JOIN g0 ON v.project_id = g0.project_id")),
)
def gate06(spark, sf):
    signals = lead_signals(spark, sf)
    machine = gates.history_rows(gates.qualify(signals, "pre_outreach", AS_OF))
    ours = signals.filter("official_verified").select("project_id", F.lit("clear").alias("new_decision"), F.lit("checked by hand").alias("reason"), F.col("official_url").alias("evidence_url"))
    kept = machine.join(ours.select("project_id"), "project_id", "left_anti")
    rows = gates.override_rows(machine, ours).unionByName(kept)
    return rows.select("project_id", "decision", "machine_decision", joined("blocker_codes"))


@query(
    "gate07_outreach_reuse",
    with_tables("lead_facts", then="""
    SELECT project_id, CASE WHEN project_id % 4 = 0 AND age <= 72 AND NOT (project_id % 5 = 0) AND project_id % 7 <> 0 THEN 'override' WHEN project_id % 7 <> 0 AND age <= 24 THEN 'reuse' ELSE 'evaluate' END AS action
    FROM (SELECT project_id, project_id % 100 AS age FROM lead_facts)"""),
)
def gate07(spark, sf):
    rows = lead_facts(spark, sf)
    fields = {n: F.col(n) for n in ("title", "category", "maker_name", "campaign_url", "japan_result")}
    digest = gates.signals_digest(fields, F.array(F.col("email")))
    n = F.col("project_id")
    current = rows.select("project_id", digest.alias("digest"))
    latest = rows.select(
        "project_id",
        F.when(n % 7 == 0, F.lit("changed")).otherwise(digest).alias("digest"),
        (n % 4 == 0).alias("overridden"),
        F.lit("clear").alias("decision"),
        F.lit("seen").alias("override_reason"),
        F.lit("https://proof.io/1").alias("override_evidence_url"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=(n % 100).cast("int"))).alias("created_at"),
        (n % 5 == 0).alias("has_stale"),
    )
    return gates.outreach_reuse(latest, current, AS_OF).select("project_id", "action")


# --- entity keys and selection ---------------------------------------------------------------------

def _keyed(spark, sf):
    from leadloom.operators.entities import maker_keys

    rows = inputs.projects(spark, sf).withColumns(
        {
            "creator_url": F.lit(None).cast("string"), "brand_name": F.lit(None).cast("string"),
            "official_url": urls.maker_site(F.col("maker_url")), "campaign_url": urls.campaign_url(F.col("source_url"), F.col("source_site")),
        }
    )
    return maker_keys(rows)


KEYS_SQL = f"""
    WITH b AS (SELECT id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(maker_url), '^(https?:)?//', ''), '^([^?#]*)', 1), '^www[.]', ''), '/+$', '') AS mu,
      regexp_replace(lower(coalesce(maker_name, '')), '[\\s.,_''"()|/-]+', '', 'g') AS nm, {CAMPAIGN_SQL} AS page, maker_url FROM projects),
    c AS (SELECT *, CASE WHEN starts_with(maker_url, 'http') AND NOT contains(maker_url, 'kickstarter') AND NOT contains(maker_url, 'test.io') THEN string_split(mu, '/')[1] END AS oh,
      regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(page), '^(https?:)?//', ''), '^([^?#]*)', 1), '^www[.]', ''), '/+$', '') AS pg, CASE WHEN contains(page, 'kickstarter') OR contains(page, 'indiegogo') THEN regexp_replace(regexp_extract(page, '^https?://([^/]*)', 1), '^www[.]', '') || '/projects/' || regexp_extract(page, '/projects/([^/]+)/', 1) END AS cr FROM b),
    u AS (SELECT id, 'url:' || mu AS key, mu AS v FROM c UNION SELECT id, 'host:' || oh, oh FROM c UNION SELECT id, 'name:' || nm, nm FROM c UNION SELECT id, 'creator:' || cr, cr FROM c UNION SELECT id, 'campaign:' || pg, pg FROM c)"""
# one step for each id in order, with the keys taken so far
WALK_SQL = """o AS (SELECT id, list(key) AS ks, row_number() OVER (ORDER BY id) AS n FROM k GROUP BY id),
    r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, false AS kept, list_filter((SELECT any_value(ks) FROM o), lambda x: false) AS taken
      UNION ALL SELECT o.n, o.id, NOT list_has_any(o.ks, r.taken), CASE WHEN list_has_any(o.ks, r.taken) THEN r.taken ELSE list_concat(r.taken, o.ks) END FROM r JOIN o ON o.n = r.n + 1)
    SELECT id FROM r WHERE kept"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("er01_maker_keys", with_tables("projects", then=f"{KEYS_SQL} SELECT id, key FROM u WHERE coalesce(v, '') <> ''"))
def er01(spark, sf):
    return _keyed(spark, sf).select("id", "key")


@query("er02_first_independent", recursive(with_tables("projects", then=f"{KEYS_SQL}, k AS (SELECT id, key FROM u WHERE coalesce(v, '') <> ''), {WALK_SQL}")))
def er02(spark, sf):
    from leadloom.operators.entities import first_independent

    return first_independent(_keyed(spark, sf).select("id", "key"))


@query("er02_orders_sharing_parts", recursive(with_tables("key_edges", then=f"WITH k AS (SELECT DISTINCT id, k AS key FROM key_edges), {WALK_SQL}")))
def er02b(spark, sf):
    from leadloom.operators.entities import first_independent

    return first_independent(table(spark, sf, "key_edges").select("id", F.col("k").alias("key")))


MATCH_SQL = f"""
    WITH u0 AS (SELECT *, maker_url AS url, {net('maker_url')} AS net, lower({upath('maker_url')}) AS lpath FROM projects),
    p AS (SELECT id, maker_id, CASE WHEN {REASON} IS NULL THEN trim(maker_url) END AS site, nullif(lower(trim(coalesce(nullif(maker_name, ''), title))), '') AS label FROM u0),
    f AS (SELECT p.*, l.id AS linked, s.m AS sm, n.m AS nm FROM p LEFT JOIN makers l ON l.id = p.maker_id
      LEFT JOIN (SELECT website_url, min(id) AS m FROM makers WHERE website_url IS NOT NULL GROUP BY 1) s ON s.website_url = p.site LEFT JOIN (SELECT lower(name) AS name, min(id) AS m FROM makers GROUP BY 1) n ON n.name = p.label),
    nw AS (SELECT id, site, label FROM f WHERE coalesce(linked, sm, nm) IS NULL),
    k AS (SELECT id, 'u:' || site AS key FROM nw WHERE site IS NOT NULL UNION SELECT id, 'n:' || label FROM nw WHERE label IS NOT NULL),
    {WALK_SQL.rpartition("SELECT id FROM r")[0].rstrip()},
    b AS (SELECT id, row_number() OVER (ORDER BY id) + (SELECT coalesce(max(id), 0) FROM makers) AS maker FROM r WHERE kept),
    bs AS (SELECT site, min(maker) AS s FROM b JOIN nw USING (id) WHERE site IS NOT NULL GROUP BY 1), bn AS (SELECT label, min(maker) AS m FROM b JOIN nw USING (id) WHERE label IS NOT NULL GROUP BY 1)
    SELECT id, coalesce(linked, sm, nm) AS maker_id, CASE WHEN linked IS NOT NULL THEN 'link' WHEN sm IS NOT NULL THEN 'website' ELSE 'name' END AS how FROM f WHERE coalesce(linked, sm, nm) IS NOT NULL
    UNION ALL SELECT nw.id, coalesce(s, m), 'new' FROM nw LEFT JOIN bs USING (site) LEFT JOIN bn USING (label)"""


@query("join09_maker_match", recursive(with_tables("projects", "makers", then=MATCH_SQL)))
def join09(spark, sf):
    from leadloom.operators import joins

    return joins.match_makers(inputs.projects(spark, sf), table(spark, sf, "makers"))


@query(
    "er03_quota_selection",
    with_tables("projects", then="""
    WITH g AS (SELECT id, source_site, coalesce(latest_recommendation, 'None') || '|' || coalesce(category, 'None') AS group_key, sha256(CAST(id AS VARCHAR)) AS h FROM projects),
    t AS (SELECT *, row_number() OVER (PARTITION BY source_site, group_key ORDER BY h) AS turn FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY source_site ORDER BY turn, group_key) AS place FROM t)
    SELECT id, source_site, CAST(place AS INT) AS place FROM p WHERE place <= CASE source_site WHEN 'kickstarter' THEN 10 WHEN 'indiegogo' THEN 5 WHEN 'wadiz' THEN 10 WHEN 'zeczec' THEN 5 ELSE 0 END"""),
)
def er03(spark, sf):
    from leadloom.operators.entities import take_quotas
    from leadloom.operators.history import round_robin

    rows = inputs.projects(spark, sf).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).withColumn("rec", F.coalesce("latest_recommendation", F.lit("None")))
    rows = round_robin(rows.withColumn("cat", F.concat_ws("|", "rec", F.coalesce("category", F.lit("None")))), ["source_site", "cat"], ["h"])
    ordered = rows.withColumn("inner_key", F.substring_index("group_key", "|", -2))
    return take_quotas(ordered, {"kickstarter": 10, "indiegogo": 5, "wadiz": 10, "zeczec": 5}, "source_site", ["turn", "inner_key"]).select("id", "source_site", "place")


@query(
    "er04_allocation",
    with_tables("projects", then="""
    WITH s AS (SELECT source_site AS stratum, count(*) AS size FROM projects GROUP BY 1), r AS (SELECT *, size / sum(size) OVER () * least(100, sum(size) OVER ()) AS raw FROM s),
    b AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, size DESC, stratum) AS place, least(100, sum(size) OVER ()) - sum(floor(raw)) OVER () AS rest FROM r)
    SELECT stratum, size, CAST(base + CASE WHEN place <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM b"""),
)
def er04(spark, sf):
    from leadloom.operators.entities import allocate

    sizes = inputs.projects(spark, sf).groupBy(F.col("source_site").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return allocate(sizes, 100)


@query(
    "er03_short_strata",
    with_tables("projects", then="""
    WITH q AS (SELECT unnest(['kickstarter', 'indiegogo', 'wadiz', 'zeczec']) AS source_site, unnest([400, 5, 400, 5]) AS quota), n AS (SELECT source_site, count(*) AS size FROM projects GROUP BY 1)
    SELECT source_site, quota, size FROM q LEFT JOIN n USING (source_site) WHERE coalesce(size, 0) < quota"""),
)
def er03_short(spark, sf):
    from leadloom.operators.entities import short_strata

    quotas = spark.createDataFrame([("kickstarter", 400), ("indiegogo", 5), ("wadiz", 400), ("zeczec", 5)], "source_site string, quota int")
    return short_strata(inputs.projects(spark, sf), quotas, "source_site")


@query(
    "er05_balanced_sample",
    with_tables("projects", then="""
    WITH s AS (SELECT id, source_site, coalesce(trim(maker_url) <> '', false) AS side, md5(concat(id, ':42')) AS draw FROM projects),
    a AS (SELECT *, row_number() OVER (PARTITION BY source_site, side ORDER BY draw, id) AS k FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY source_site ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, draw, id) AS place FROM a)
    SELECT id, source_site, side, CAST(place AS INT) AS place FROM p WHERE place <= 20"""),
)
def er05(spark, sf):
    from leadloom.operators.entities import balanced_sample

    rows = balanced_sample(inputs.projects(spark, sf), 20, "source_site", "maker_url", seed=42)
    return rows.select("id", "source_site", "side", "place")


@query(
    "er07_research_seed",
    with_tables("projects", then=f"""
    WITH p AS (SELECT id, {CAMPAIGN_SQL} AS page, maker_url FROM projects)
    SELECT id, CASE WHEN page IS NOT NULL THEN 'campaign_url' WHEN starts_with(maker_url, 'http') AND NOT contains(maker_url, 'test.io') THEN 'maker_url' WHEN id % 2 = 0 THEN 'official_site' END AS seed,
      CASE WHEN page IS NOT NULL THEN '' ELSE concat_ws(',', CASE WHEN id % 2 = 1 THEN 'official_site:dummy_host:example' END, CASE WHEN id % 3 = 0 THEN 'email_domain:reserved' END) END AS signals FROM p"""),
)
def er07(spark, sf):
    from leadloom.operators.entities import placeholder_signals, research_seed

    n = F.col("id")
    site = F.when(n % 2 == 0, "https://brand.com/").otherwise("https://example.com/")
    domain = F.when(n % 3 == 0, "test.org").otherwise("brand.com")
    rows = inputs.projects(spark, sf).withColumn("page", urls.campaign_url(F.col("source_url"), F.col("source_site")))
    return rows.select("id", research_seed(F.col("page"), F.col("maker_url"), site).alias("seed"), F.array_join(placeholder_signals(F.col("page"), site, domain), ",").alias("signals"))


REQUEUE = f"""cx AS (SELECT * FROM contacts QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) = 1),
busy AS (SELECT DISTINCT project_id FROM jobs WHERE status = 'running'),
rq AS (SELECT o.project_id, count(*) AS outreach_rows FROM outreach o GROUP BY 1),
x AS (SELECT rq.*, p.id IS NOT NULL AS ex, p.archived_at, {CAMPAIGN_SQL} AS page, p.maker_url, cx.official_site_url AS site, cx.primary_email AS mail, cx.recommended_channel AS rc, busy.project_id IS NOT NULL AS busy
  FROM rq LEFT JOIN projects p ON p.id = rq.project_id LEFT JOIN cx ON cx.project_id = rq.project_id LEFT JOIN busy ON busy.project_id = rq.project_id),
y AS (SELECT *, CASE WHEN page IS NOT NULL THEN 'campaign_url' WHEN starts_with(maker_url, 'http') AND NOT contains(maker_url, 'test.io') THEN 'maker_url' WHEN site IS NOT NULL THEN 'official_site' END AS seed FROM x),
z AS (SELECT *, CASE WHEN NOT ex THEN 'no_project' WHEN archived_at IS NOT NULL THEN 'archived' WHEN rc = 'press' THEN 'v2_completed' WHEN seed IS NULL THEN 'no_seed' WHEN busy THEN 'active_job' END AS why FROM y),
w AS (SELECT *, row_number() OVER (PARTITION BY why IS NULL ORDER BY project_id) AS n FROM z),
requeue AS (SELECT project_id, outreach_rows, seed, CASE WHEN why IS NULL AND n > 50 THEN 'over_limit' ELSE why END AS reason FROM w)"""


def requeue(spark, sf):
    from leadloom.operators.entities import requeue_candidates
    from leadloom.operators.history import latest_by_id

    newest = latest_by_id(table(spark, sf, "contacts"), columns=["primary_email", "official_site_url", "recommended_channel"])
    newest = newest.withColumn("v2_status", F.when(F.col("recommended_channel") == "press", "completed").otherwise("failed"))
    active = table(spark, sf, "jobs").filter("status = 'running'").select("project_id")
    return requeue_candidates(table(spark, sf, "outreach"), inputs.projects(spark, sf), newest, active, limit=50)


@query("er08_requeue_candidates", with_tables("projects", "contacts", "jobs", "outreach", then=f"WITH {REQUEUE} SELECT project_id, outreach_rows, seed, reason FROM requeue"))
def er08(spark, sf):
    return requeue(spark, sf).select("project_id", "outreach_rows", "seed", "reason")


@query(
    "agg18_requeue_summary",
    with_tables("projects", "contacts", "jobs", "outreach", then=f"""WITH {REQUEUE}, r AS (SELECT CASE project_id % 4 WHEN 0 THEN 'enqueued' WHEN 1 THEN 'skipped_gate' WHEN 2 THEN 'timed_out' ELSE 'cache_reused' END AS result FROM requeue WHERE reason IS NULL)
    SELECT (SELECT count(*) FROM r) AS attempted, (SELECT count(*) FROM r WHERE result = 'enqueued') AS enqueued, (SELECT count(*) FROM r WHERE starts_with(result, 'skipped')) AS skipped, 0::BIGINT AS failed,
      (SELECT count(*) FROM r WHERE result = 'timed_out') AS timed_out, count(*) FILTER (WHERE reason = 'active_job') AS active_job_skipped, count(*) FILTER (WHERE reason = 'v2_completed') AS already_completed_skipped,
      0::BIGINT AS dummy_or_test_skipped, count(*) FILTER (WHERE reason = 'no_seed') AS no_research_seed_skipped, count(*) FILTER (WHERE reason = 'archived') AS archived_skipped, (SELECT count(*) FROM r WHERE result = 'cache_reused') AS cache_reused, 0::BIGINT AS gate_blocked FROM requeue WHERE reason IS NOT NULL"""),
)
def agg18(spark, sf):
    from leadloom.operators.aggregates import requeue_summary

    rows = requeue(spark, sf)
    n = F.col("project_id") % 4
    result = F.when(n == 0, "enqueued").when(n == 1, "skipped_gate").when(n == 2, "timed_out").otherwise("cache_reused")
    return requeue_summary(rows.filter("reason IS NULL").select(result.alias("result")), rows.filter("reason IS NOT NULL").select("reason"))


@query(
    "er09_prediction_snapshot",
    with_tables("contact_layers", then="""
    WITH f AS (SELECT project_id, kind, min((layer_rank, trim(value))) AS f FROM contact_layers WHERE trim(value) <> '' GROUP BY project_id, kind, lower(trim(value)))
    SELECT project_id, """ + ", ".join(f"coalesce(array_to_string(list_transform(list_sort(list(f) FILTER (WHERE kind = '{k}')), lambda x: x[2]), ','), '') AS {c}" for k, c in (("email", "emails"), ("site", "sites"), ("form", "forms"), ("social", "socials"), ("person", "people"), ("evidence", "evidence_urls")))
    + " FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE kind <> 'evidence') > 0"),
)
def er09(spark, sf):
    from leadloom.operators.entities import prediction_snapshot

    rows = prediction_snapshot(table(spark, sf, "contact_layers"))
    return rows.select("project_id", *[joined(c) for c in ("emails", "sites", "forms", "socials", "people", "evidence_urls")])


@query(
    "set05_merged_socials",
    with_tables("contact_layers", then="""
    WITH l AS (SELECT project_id, kind AS platform, arg_min(value, (layer_rank, value)) AS url FROM contact_layers WHERE value <> '' GROUP BY 1, 2)
    SELECT project_id, arg_min(url, (CASE platform WHEN 'social' THEN 9 ELSE 8 END, platform)) AS primary_social_url FROM l GROUP BY 1""".replace("CASE platform WHEN 'social' THEN 9 ELSE 8 END", "7")),
)
def set05(spark, sf):
    from leadloom.operators.sets import merge_socials, primary_social

    rows = table(spark, sf, "contact_layers").select("project_id", "layer_rank", F.col("kind").alias("platform"), F.col("value").alias("url"))
    return primary_social(merge_socials(rows))


@query(
    "set06_new_versus_known",
    with_tables("addresses", then="""
    WITH f AS (SELECT DISTINCT project_id, lower(email) AS e FROM addresses), k AS (SELECT DISTINCT project_id, lower(email) AS e FROM addresses WHERE position < 4)
    SELECT f.project_id, count(*) FILTER (WHERE k.e IS NULL) AS new_count, count(*) FILTER (WHERE k.e IS NOT NULL) AS known_count FROM f LEFT JOIN k ON f.project_id = k.project_id AND f.e = k.e GROUP BY 1"""),
)
def set06(spark, sf):
    from leadloom.operators.sets import new_versus_known

    rows = table(spark, sf, "addresses").select("project_id", "email", "position")
    return new_versus_known(rows, rows.filter("position < 4").withColumn("email", F.upper("email"))).select("project_id", "new_count", "known_count")


# --- evaluation ---------------------------------------------------------------------------------------

def cases(spark, sf):
    arr = lambda *cols: F.array_compact(F.array(*[F.col(c) for c in cols]))
    return table(spark, sf, "label_cases").withColumns(
        {
            "expected_direct_emails": arr("expected_email"), "plausible_unconfirmed_emails": arr("plausible_email"), "expected_fallback_emails": arr("fallback_email"),
            "emails": arr("saved_email", "saved_email2"), "fallback_emails": arr("saved_email2"), "expected_official_site": F.col("expected_site"), "sites": arr("saved_site"),
            "expected_forms": F.array(F.concat(F.lit("https://brand.com/"), F.when(F.col("project_id") % 2 == 0, "contact").otherwise("wholesale"))),
            "forms": F.when(F.col("project_id") % 3 == 0, F.array(F.lit("https://www.brand.com/contact-us"))).otherwise(F.array().cast("array<string>")),
            "expected_socials": F.array(F.lit("https://www.instagram.com/brand/")),
            "socials": F.when(F.col("project_id") % 4 == 0, F.array(F.lit("https://instagram.com/brand"), F.lit("https://facebook.com/kickstarter"))).otherwise(F.array().cast("array<string>")),
        }
    )


PREDICTED = ("emails", "fallback_emails", "sites", "forms", "socials", "saved_person", "saved_role", "saved_email", "saved_email2", "saved_site")


def truth_and_predictions(spark, sf):
    """Labels of projects, and predictions of those that any search gave something for, as two tables."""
    rows = cases(spark, sf)
    found = F.coalesce(*[F.col(c) for c in ("saved_email", "saved_email2", "saved_site", "saved_person")]).isNotNull() | (F.size("forms") > 0) | (F.size("socials") > 0)
    predictions = rows.filter(found).select("project_id", *PREDICTED)
    extra = rows.filter("verification_status = 'unresolved'").select((F.col("project_id") + 1_000_000_000).alias("project_id"), *PREDICTED)
    return rows.drop(*PREDICTED), predictions.unionByName(extra)


def strict_cases(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.scored(*truth_and_predictions(spark, sf))


@query(
    "join13_prediction_coverage",
    with_tables("label_cases", then="""WITH p AS (SELECT project_id FROM label_cases WHERE coalesce(saved_email, saved_email2, saved_site, saved_person) IS NOT NULL OR project_id % 3 = 0 OR project_id % 4 = 0)
    SELECT verification_status, count(*) AS n_labels, CASE WHEN verification_status = 'verified' THEN count(*) ELSE 0 END AS n_counted, count(*) FILTER (WHERE project_id IN (SELECT project_id FROM p)) AS n_with_prediction, CAST(0 AS BIGINT) AS n_unlabelled FROM label_cases GROUP BY 1
    UNION ALL SELECT NULL, 0, 0, 0, count(*) FROM label_cases WHERE verification_status = 'unresolved'"""),
)
def join13(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.coverage(*truth_and_predictions(spark, sf))


_E = "list_distinct(list_transform(list_filter([{0}], lambda v: v IS NOT NULL), lambda v: lower(v)))"
PRF = "tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) END AS f1"


def without(a: str, b: str) -> str:
    return f"list_filter({a}, lambda v: NOT list_contains({b}, v))"


@query(
    "eval01_email_scores",
    with_tables("label_cases", then=f"""WITH s AS (SELECT source_site, {_E.format('expected_email')} AS e, {_E.format('saved_email, saved_email2')} AS p, {_E.format('plausible_email')} AS u FROM label_cases WHERE verification_status = 'verified'),
    c AS (SELECT source_site, count(*) AS n, CAST(sum(len(list_intersect(e, p))) AS BIGINT) AS tp, CAST(sum(len({without(without('p', 'e'), 'u')})) AS BIGINT) AS fp, CAST(sum(len({without('e', 'p')})) AS BIGINT) AS fn FROM s GROUP BY 1)
    SELECT source_site, n, tp, fp, fn, {PRF} FROM c"""),
)
def eval01(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.email_scores(strict_cases(spark, sf), by="source_site")


@query(
    "eval02_official_scores",
    with_tables("label_cases", then=f"""WITH s AS (SELECT 'brand' || CAST(project_id % 9 AS VARCHAR) || '.com' AS e, CASE WHEN saved_site IS NULL THEN NULL WHEN contains(saved_site, 'reseller') THEN 'reseller.net' ELSE 'brand' || CAST(project_id % 9 AS VARCHAR) || '.com' END AS p FROM label_cases WHERE verification_status = 'verified' AND expected_site IS NOT NULL),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p = e) AS tp, count(*) FILTER (WHERE p <> e) AS fp, count(*) FILTER (WHERE p IS NULL OR p <> e) AS fn FROM s) SELECT n, tp, fp, fn, {PRF} FROM c"""),
)
def eval02(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.official_scores(strict_cases(spark, sf))


@query(
    "eval03_form_scores",
    with_tables("label_cases", then=f"""WITH s AS (SELECT project_id % 2 = 0 AS c, project_id % 3 = 0 AS f FROM label_cases WHERE verification_status = 'verified'),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE c AND f) AS tp, count(*) FILTER (WHERE NOT c AND f) AS fp, count(*) FILTER (WHERE NOT (c AND f)) AS fn FROM s) SELECT n, tp, fp, fn, {PRF} FROM c"""),
)
def eval03(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.form_scores(strict_cases(spark, sf))


@query(
    "eval03_social_scores",
    with_tables("label_cases", then=f"""WITH s AS (SELECT project_id % 4 = 0 AS f FROM label_cases WHERE verification_status = 'verified'),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE f) AS tp, 0::BIGINT AS fp, count(*) FILTER (WHERE NOT f) AS fn FROM s) SELECT n, tp, fp, fn, {PRF} FROM c"""),
)
def eval03b(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.social_scores(strict_cases(spark, sf))


@query(
    "eval04_case_counts",
    with_tables("label_cases", then=f"""WITH s AS (SELECT verification_status = 'verified' AS v, {_E.format('expected_email')} AS e, {_E.format('saved_email, saved_email2')} AS p, {_E.format('plausible_email')} AS u, fallback_email, saved_email2 FROM label_cases)
    SELECT count(*) FILTER (WHERE v) AS verified, count(*) FILTER (WHERE v AND list_has_any(e, p)) AS with_direct, count(*) FILTER (WHERE v AND len({without(without('p', 'u'), 'e')}) > 0) AS with_wrong, count(*) FILTER (WHERE fallback_email IS NOT NULL) AS fallback_cases,
      count(*) FILTER (WHERE fallback_email = saved_email2) AS with_fallback, count(*) FILTER (WHERE list_contains(p, 'help@kickstarter.com')) AS platform_as_direct, count(*) FILTER (WHERE list_contains(p, 'a@ideafound.com')) AS agency_as_direct, 0::BIGINT AS shortener_as_direct FROM s"""),
)
def eval04(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.case_counts(cases(spark, sf))


@query(
    "eval07_people_scores",
    with_tables("label_cases", then=f"""WITH s AS (SELECT *, lower(expected_person) AS e, lower(regexp_replace(saved_person, '\\s+', ' ', 'g')) AS p, lower(expected_role) AS er, lower(saved_role) AS pr FROM label_cases),
    r AS (SELECT *, CASE WHEN p = e THEN CASE WHEN pr = '' THEN 'missing' WHEN pr = er OR contains(pr, er) OR contains(er, pr) THEN 'exact' WHEN pr = 'president' AND er = 'ceo' THEN 'compatible' ELSE 'mismatch' END END AS rel FROM s),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p = e) AS tp, count(*) FILTER (WHERE p <> e) AS fp, count(*) FILTER (WHERE p IS NULL OR p <> e) AS fn, count(*) FILTER (WHERE rel = 'exact') AS exact, count(*) FILTER (WHERE rel = 'compatible') AS compatible,
      count(*) FILTER (WHERE rel = 'mismatch') AS mismatch, count(*) FILTER (WHERE rel = 'missing') AS missing FROM r) SELECT *, {PRF} FROM c"""),
)
def eval07(spark, sf):
    from leadloom.operators import evaluation as ev

    rows = table(spark, sf, "label_cases")
    predicted = rows.filter("saved_person IS NOT NULL").select("project_id", F.col("saved_person").alias("name"), F.col("saved_role").alias("role"))
    return ev.people_scores(rows.select("project_id", F.col("expected_person").alias("name"), F.col("expected_role").alias("role")), predicted)


def qualification_cases(spark, sf):
    from leadloom.operators import evaluation as ev

    signals = lead_signals(spark, sf)
    return ev.qualification_rows(gates.qualify(signals, "pre_research", AS_OF), gates.qualify(signals, "pre_outreach", AS_OF), table(spark, sf, "label_cases"))


def _two_stages() -> str:
    a = qualification_sql("pre_research").removeprefix("WITH ").replace("w AS (", "w1 AS (").replace("FROM w)", "FROM w1)").replace("v AS (SELECT", "v1 AS (SELECT").replace("FROM v", "FROM v1")
    b = qualification_sql("pre_outreach").split("FROM g2)", 1)[1].lstrip(", ")
    head, tail = a.rsplit("SELECT project_id, CASE WHEN blocker_codes", 1)
    bhead, btail = b.rsplit("SELECT project_id, CASE WHEN blocker_codes", 1)
    return f"WITH {head.rstrip()}, q1 AS (SELECT project_id, CASE WHEN blocker_codes{tail}), {bhead.rstrip()}, q2 AS (SELECT project_id, CASE WHEN blocker_codes{btail})"


@query(
    "eval05_qualification_by_site",
    with_tables("lead_facts", "label_cases", then=f"""{_two_stages()}, m AS (SELECT l.*, q1.decision AS d1, q2.decision AS d2 FROM label_cases l JOIN q1 ON q1.project_id = l.project_id JOIN q2 ON q2.project_id = l.project_id WHERE verification_status IN ('verified', 'partially_verified'))
    SELECT source_site, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE {c} = '{d}') AS {s}_{d}" for s, c in (('pre_research', 'd1'), ('pre_outreach', 'd2')) for d in ('blocked', 'review', 'clear'))},
      count(*) FILTER (WHERE d1 = expected_pre_research) AS match_pre_research, count(*) FILTER (WHERE d2 = expected_pre_outreach) AS match_pre_outreach, round_even(count(*) FILTER (WHERE d1 = expected_pre_research) * 100.0::DOUBLE / count(*), 1) AS match_percent FROM m GROUP BY 1"""),
)
def eval05(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.metrics_by_site(qualification_cases(spark, sf))


@query("eval05_qualification_metrics")
def eval05b(spark, sf):
    from leadloom.operators import evaluation as ev

    return ev.qualification_metrics(qualification_cases(spark, sf))


@query("eval06_input_problems", with_tables("label_cases", then="SELECT 'missing_reviewer_note' AS \"check\", CAST(project_id AS VARCHAR) AS detail FROM label_cases WHERE reviewer_note = '' UNION ALL SELECT 'label_without_case', CAST(project_id AS VARCHAR) FROM label_cases WHERE project_id % 50 = 7 UNION ALL SELECT 'duplicate_maker_key', '1' WHERE (SELECT count(*) FROM label_cases WHERE project_id % 100 = 1 AND project_id % 50 <> 7) > 1"))
def eval06(spark, sf):
    from leadloom.operators import evaluation as ev

    labels = table(spark, sf, "label_cases").withColumn("case_id", F.col("project_id"))
    kept = labels.filter("project_id % 50 <> 7")
    key = F.when(F.col("project_id") % 100 == 1, F.lit(1)).otherwise(F.col("project_id") + 1000)
    found = kept.withColumn("canonical_maker_key", key)
    quotas = kept.groupBy("source_site").agg(F.count(F.lit(1)).alias("quota"))
    return ev.input_problems(found, labels, quotas, ("reviewer_note",))


@query(
    "eval08_label_errors",
    with_tables("label_cases", then="""WITH t AS (SELECT *, coalesce(gt_status, '') AS st, coalesce(gt_official_url, '') AS u, coalesce(gt_registered_domain, '') AS r, coalesce(evidence_type, '') AS ev, coalesce(confidence, '') AS cf FROM label_cases)
    SELECT project_id, CASE WHEN st = '' THEN '' ELSE concat_ws(';', CASE WHEN st = 'wrong' THEN 'invalid:gt_status' END, CASE WHEN ev = 'magic' THEN 'invalid:evidence_type' END, CASE WHEN cf = 'sure' THEN 'invalid:confidence' END,
      CASE WHEN st = 'confirmed' AND u = '' THEN 'missing:gt_official_url' END, CASE WHEN st = 'confirmed' AND r = '' THEN 'missing:gt_registered_domain' END, CASE WHEN st = 'confirmed' AND ev = '' THEN 'missing:evidence_type' END,
      CASE WHEN st = 'confirmed' THEN 'missing:evidence_url' END, CASE WHEN st = 'confirmed' AND reviewer_note = '' THEN 'missing:reviewer_note' END, CASE WHEN st = 'confirmed' AND cf = '' THEN 'missing:confidence' END,
      CASE WHEN st = 'confirmed' AND u <> '' AND r <> '' AND CASE project_id % 10 WHEN 0 THEN '1.1' WHEN 1 THEN 'b.com' WHEN 2 THEN 'brand.co.jp' ELSE 'brand.com' END <> r THEN 'domain_mismatch' END,
      CASE WHEN st IN ('none', 'excluded') AND u <> '' THEN 'unexpected:gt_official_url' END, CASE WHEN st IN ('none', 'excluded') AND r <> '' THEN 'unexpected:gt_registered_domain' END,
      CASE WHEN st IN ('none', 'excluded', 'ambiguous', 'unreachable') AND reviewer_note = '' THEN 'missing:reviewer_note' END, CASE WHEN project_id % 10 = 0 THEN 'url_rejected:private_ip' WHEN project_id % 10 = 1 THEN 'url_rejected:email_not_url' END,
      CASE WHEN project_id % 10 = 1 THEN 'private_data:gt_official_url:email' END, CASE project_id % 8 WHEN 1 THEN 'private_data:reviewer_note:email' WHEN 2 THEN 'private_data:reviewer_note:secret' WHEN 3 THEN 'private_data:reviewer_note:phone' END) END AS errors FROM t"""),
)
def eval08(spark, sf):
    from leadloom.operators import evaluation as ev

    rows = table(spark, sf, "label_cases").withColumn("evidence_url", F.lit(None).cast("string"))
    return rows.select("project_id", F.array_join(ev.label_errors(), ";").alias("errors"))


@query(
    "agg13_audit_funnel",
    with_tables("lead_facts", "projects", then=f"""WITH f AS (SELECT l.project_id, p.archived_at, {CAMPAIGN_SQL.replace('source_site', 'l.source_site').replace('source_url', 'l.source_url')} AS page, l.maker_name, l.official_url, l.project_id % 9 = 0 AS done, l.project_id % 14 = 5 AS busy FROM lead_facts l JOIN projects p ON p.id = l.project_id),
    m AS (SELECT *, CASE WHEN archived_at IS NOT NULL THEN 'archived' WHEN done THEN 'v2_completed' WHEN page IS NULL AND project_id % 2 = 1 THEN 'dummy' WHEN page IS NULL AND official_url IS NULL THEN 'no_seed' WHEN page IS NULL THEN 'no_campaign_url' WHEN busy THEN 'active_job' ELSE 'in_population' END AS membership FROM f)
    SELECT 'membership' AS section, membership AS key, count(*) AS n, NULL::BIGINT AS denominator, NULL::DOUBLE AS percent FROM m GROUP BY 2
    UNION ALL SELECT 'evidence', k, n, d, round_even(n * 100.0::DOUBLE / d, 1) FROM (SELECT unnest(['has_maker_name', 'has_official_site', 'has_campaign_url']) AS k, unnest([count(*) FILTER (WHERE coalesce(maker_name, '') <> ''), count(*) FILTER (WHERE official_url IS NOT NULL), count(page)]) AS n, count(*) AS d FROM m WHERE membership = 'in_population')
    UNION ALL SELECT 'decision', CASE WHEN project_id % 3 = 0 THEN 'blocked' ELSE 'clear' END, count(*), (SELECT count(*) FROM m WHERE membership = 'in_population'), round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM m WHERE membership = 'in_population'), 1) FROM m WHERE membership = 'in_population' GROUP BY 2
    UNION ALL SELECT 'code', 'T', count(*), (SELECT count(*) FROM m WHERE membership = 'in_population'), round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM m WHERE membership = 'in_population'), 1) FROM m WHERE membership = 'in_population' AND project_id % 4 = 0 HAVING count(*) > 0"""),
)
def agg13(spark, sf):
    from leadloom.operators.aggregates import audit_funnel, membership

    rows = lead_facts(spark, sf).join(inputs.projects(spark, sf).select(F.col("id").alias("project_id"), "archived_at"), "project_id")
    n, page = F.col("project_id"), F.col("campaign_url")
    reason = membership(
        {
            "archived": F.col("archived_at").isNotNull(), "v2_completed": n % 9 == 0, "dummy": page.isNull() & (n % 2 == 1), "no_seed": page.isNull() & F.col("official_url").isNull(),
            "no_campaign_url": page.isNull(), "active_job": n % 14 == 5,
        }
    )
    records = rows.select(
        reason.alias("membership"), (F.coalesce("maker_name", F.lit("")) != "").alias("has_maker_name"), F.col("official_url").isNotNull().alias("has_official_site"), page.isNotNull().alias("has_campaign_url"),
        F.when(n % 3 == 0, "blocked").otherwise("clear").alias("decision"), F.when(n % 4 == 0, F.array(F.lit("T"))).otherwise(F.array().cast("array<string>")).alias("codes"),
    )
    return audit_funnel(records).drop("position")


@query(
    "agg16_outcomes",
    with_tables("contact_layers", then="""WITH c AS (SELECT project_id, count(*) FILTER (WHERE kind = 'email') AS emails, count(*) FILTER (WHERE kind = 'form') AS forms, count(*) FILTER (WHERE kind = 'social') AS socials, count(*) FILTER (WHERE kind = 'person') AS people FROM contact_layers WHERE layer_rank = 0 GROUP BY 1)
    SELECT project_id, CASE WHEN project_id % 5 = 0 AND emails + people + forms + socials > 0 THEN 'partial' WHEN emails + people > 0 THEN 'with_contacts' WHEN forms + socials > 0 THEN 'with_channels' ELSE 'none' END AS outcome FROM c"""),
)
def agg16(spark, sf):
    from leadloom.operators.aggregates import count_where, outcome

    kinds = {"emails": "email", "forms": "form", "socials": "social", "people": "person"}
    rows = table(spark, sf, "contact_layers").filter("layer_rank = 0").groupBy("project_id").agg(*[count_where(F.col("kind") == k, n) for n, k in kinds.items()])
    return rows.select("project_id", outcome({n: F.col(n) for n in kinds}, F.col("project_id") % 5 == 0).alias("outcome"))


@query(
    "agg17_search_diagnostics",
    with_tables("results", then="""WITH q AS (SELECT id, position % 4 > 0 AS ok, position % 3 = 0 AS fb, CASE WHEN position % 5 = 0 THEN NULL ELSE 'http ' || CAST(position % 5 AS VARCHAR) END AS st FROM results)
    SELECT 'query' AS section, CASE WHEN fb THEN 'fallback' ELSE 'direct' END AS key, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS zero, count(*) FILTER (WHERE ok) > 0 AS succeeded FROM q GROUP BY 2
    UNION ALL SELECT 'status', st, count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok), count(*) FILTER (WHERE ok) > 0 FROM q WHERE st IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'provider', 'first', count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok), count(*) FILTER (WHERE ok) > 0 FROM q UNION ALL SELECT 'provider', 'second', 0, count(*), false FROM q WHERE fb"""),
)
def agg17(spark, sf):
    from leadloom.operators.aggregates import search_diagnostics

    n = F.col("position")
    one = lambda name, res: F.struct(F.lit(name).alias("provider"), res.cast("int").alias("results"))
    providers = F.array_compact(F.array(one("first", n % 4), F.when(n % 3 == 0, one("second", F.lit(0)))))
    status = F.when(n % 5 != 0, F.concat(F.lit("http "), (n % 5).cast("string")))
    rows = table(spark, sf, "results").select((n % 4).alias("results"), (n % 3 == 0).alias("fallback"), status.alias("status"), providers.alias("providers"))
    return search_diagnostics(rows)


@query(
    "score12_opportunities",
    with_tables("contacts", "projects", "opportunities", then="""WITH c AS (SELECT * FROM contacts WHERE id NOT IN (SELECT contact_discovery_id FROM opportunities WHERE contact_discovery_id IS NOT NULL)),
    s AS (SELECT c.id, coalesce(contactability_score, 0) AS sc, p.maker_name, p.title, c.recommended_channel, primary_email, found_email, primary_contact_form_url, linkedin_url, instagram_url, facebook_url FROM c LEFT JOIN projects p ON p.id = c.project_id)
    SELECT id AS contact_discovery_id, maker_name AS company_name, title AS product_name, sc AS sales_score, CASE WHEN sc >= 70 THEN 'high' WHEN sc >= 40 THEN 'medium' ELSE 'low' END AS sales_priority, recommended_channel,
      coalesce(found_email, nullif(primary_email, '')) AS primary_email, primary_contact_form_url AS contact_form_url, coalesce(linkedin_url, instagram_url, facebook_url) AS primary_social_url FROM s"""),
)
def score12(spark, sf):
    from leadloom.operators.opportunities import derive_opportunities

    found = inputs.contacts(spark, sf)
    existing = table(spark, sf, "opportunities").filter("contact_discovery_id IS NOT NULL").select("contact_discovery_id")
    ranked = found.select(F.col("id").alias("contact_id"), F.col("found_email").alias("top_email"))
    return derive_opportunities(found, inputs.projects(spark, sf), existing, ranked).drop("website_url")


@query(
    "flow08_outcome_codes",
    with_tables("results", then="""SELECT id, concat_ws(',', CASE WHEN position % 7 = 0 THEN 'provider_failed' END, CASE WHEN position % 11 = 0 THEN 'no_results' END, CASE WHEN position % 13 = 0 THEN 'official_site_not_registered' END, CASE WHEN position % 5 = 0 THEN 'crawl_blocked' END,
      CASE WHEN position % 2 = 0 THEN 'email_not_public' END, CASE WHEN position % 2 = 0 AND position % 3 = 0 THEN 'mx_exists_no_email' END, CASE WHEN position % 2 = 0 AND position % 4 = 0 THEN 'form_only' END, CASE WHEN position % 2 = 0 AND position % 4 <> 0 AND position % 6 = 0 THEN 'social_only' END,
      CASE WHEN position % 2 = 0 AND position % 8 = 0 THEN 'document_without_email' END, CASE WHEN position = 9 THEN 'rate_limited' END, CASE WHEN position = 10 THEN 'timeout' END, CASE WHEN position = 11 THEN 'login_required' END) AS codes FROM results"""),
)
def flow08(spark, sf):
    from leadloom.operators.flow import crawl_outcome_codes

    n = F.col("position")
    one = lambda c: F.when(c, 1).otherwise(0)
    facts = {
        "n_emails": one(n % 2 == 1), "n_forms": one(n % 4 == 0), "n_socials": one(n % 6 == 0), "n_documents_read": one(n % 8 == 0), "provider_failed": n % 7 == 0, "no_results": n % 11 == 0,
        "site_not_registered": n % 13 == 0, "blocked": n % 5 == 0, "has_mx": n % 3 == 0, "rate_limited": n == 9, "timed_out": n == 10, "login_required": n == 11,
    }
    return table(spark, sf, "results").select("id", F.array_join(crawl_outcome_codes(facts), ",").alias("codes"))

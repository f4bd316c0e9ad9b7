"""Entity keys, first-come de-duplication, quotas and requeue rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.functions import urls

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate tables; only a local session
    without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local["):
        app = spark.sparkContext.applicationId
        folder = _own_folders.setdefault(app, _own_folders.get(app) or tempfile.mkdtemp(prefix="leadloom-"))
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def new_table(spark: SparkSession) -> str:
    """A path for an intermediate table, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/leadloom-{uuid.uuid4().hex}"
    atexit.register(_drop_at_exit, spark, path)
    return path


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop_table(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder is left to its owner
        pass


def drop_table(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: a lost executor costs a
    re-read, and the next round plans with real table sizes."""
    spark = rows.sparkSession
    path = path or new_table(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def rank_within(rows: DataFrame, keys, order, name: str, row_id: str | None = None) -> DataFrame:
    """Position 1..n inside every key in the given order, without putting a whole key
    into one task.

    Rows are range-partitioned by key and order, numbered inside each partition, and
    shifted by the key's counts in the partitions before. The partition numbers are
    written down first, so both uses of them agree. Where ``row_id`` names a column that tells all rows apart, only it and
    the columns of key and order are written and sorted, the input is read once for that, and the rows get their position by a join.
    """
    keys, order = list(keys), list(order)
    if row_id:
        narrow = cut_lineage(rows.select(*dict.fromkeys([row_id, *keys, *order])))
        places = rank_within(narrow, keys, order, name).select(row_id, name)
        return rows.join(places, row_id)
    sorted_rows = rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id())
    parts = cut_lineage(sorted_rows)
    inner = parts.withColumn(name, F.row_number().over(Window.partitionBy("part", *keys).orderBy(*order)))
    sizes = parts.groupBy("part", *keys).agg(F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", *keys, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    return (
        inner.join(shifts, ["part", *keys])
        .withColumn(name, (F.col(name) + F.col("shift")).cast("long"))
        .drop("part", "shift")
    )


def component_labels(keys: DataFrame) -> DataFrame:
    """(id, label): for every id the least id that it is connected to by shared keys.

    A round lowers an id's label to the least one among its keys and then follows labels twice, so labels cross a chain in steps that
    double, and the number of rounds grows with the logarithm of the longest chain. Per-key minima travel, never pairs.
    """
    spark = keys.sparkSession
    at = new_table(spark)
    labels = cut_lineage(keys.select("id", F.col("id").alias("label")).distinct(), at)
    while True:
        least = keys.join(labels, "id").groupBy("key").agg(F.min("label").alias("label"))
        paths = [new_table(spark) for _ in range(3)]
        lower = cut_lineage(keys.join(least, "key").groupBy("id").agg(F.min("label").alias("label")), paths[0])
        for path in paths[1:]:
            to = lower.select(F.col("id").alias("label"), F.col("label").alias("onward"))
            lower = cut_lineage(lower.join(to, "label", "left").select("id", F.coalesce("onward", "label").alias("label")), path)
        done = lower.join(labels, ["id", "label"], "left_anti").isEmpty()
        for path in (at, *paths[:2]):
            drop_table(spark, path)
        labels, at = lower, paths[2]
        if done:
            return labels


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids kept of rows (label, id, key) in order; holds the taken keys of one component and the keys of one id."""
    label = id = None
    taken: set[str] = set()
    own: list[str] = []

    def closed() -> list[int]:
        if id is None or not taken.isdisjoint(own):
            return []
        taken.update(own)
        return [id]

    for batch in batches:
        kept = []
        for next_label, next_id, key in zip(*(batch.column(c).to_pylist() for c in ("label", "id", "key"))):
            if next_id != id or next_label != label:
                kept += closed()
                own = []
                if next_label != label:
                    taken = set()
                label, id = next_label, next_id
            own.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["id"])
    yield pa.RecordBatch.from_arrays([pa.array(closed(), pa.int64())], names=["id"])


def first_independent(keys: DataFrame, rounds: int = 5) -> DataFrame:
    """Ids kept when walking in id order and skipping any id that shares a key with
    an id kept before. A skipped id's keys block nobody.

    ``keys(id, key)``. A round keeps every id that is the smallest open one on
    all of its keys and drops the ids touching a kept key. Only per-key minima
    travel, never pairs, so a key held by a third of the ids costs one row per
    task, and is gone after a round. What is open after ``rounds`` rounds are chains, where each id waits for
    the one before it. They fall apart into components, and each component is walked in order of its ids, as a
    stream of rows that holds the keys taken so far. So the number of jobs does not follow the longest chain.
    """
    spark = keys.sparkSession
    kept, at = new_table(spark), new_table(spark)
    open_ = cut_lineage(keys.select("id", F.col("key").cast("string").alias("key")).filter("id IS NOT NULL AND key IS NOT NULL").distinct(), at)
    for step in range(rounds):
        leaders = open_.groupBy("key").agg(F.min("id").alias("leader"))
        winners = cut_lineage(
            open_.join(leaders, "key")
            .groupBy("id")
            .agg(F.bool_and(F.col("leader") == F.col("id")).alias("wins"))
            .filter("wins")
            .select("id"),
            f"{kept}/round={step}",
        )
        taken = open_.join(winners, "id", "left_semi").select("key").distinct()
        losers = open_.join(taken, "key", "left_semi").select("id").distinct()
        before, at = at, new_table(spark)
        open_ = cut_lineage(open_.join(losers, "id", "left_anti"), at)
        drop_table(spark, before)
        if open_.isEmpty():
            break
    else:
        chains = open_.join(component_labels(open_), "id").select("label", F.col("id").cast("long").alias("id"), "key")
        ordered = chains.repartition("label").sortWithinPartitions("label", "id")
        ordered.mapInArrow(_walked, "id long").select(F.col("id").cast(winners.schema["id"].dataType)).write.parquet(f"{kept}/round={rounds}")
    drop_table(spark, at)
    return spark.read.schema(winners.schema).option("recursiveFileLookup", True).parquet(kept)


# --- maker keys ---------------------------------------------------------------------------

def bare_name(name: Column) -> Column:
    """Name for comparison: NFKC, lower case, no blanks or punctuation."""
    from leadloom.functions.pandas_udfs import nfkc

    return F.regexp_replace(F.lower(nfkc(F.coalesce(name, F.lit("")))), r"[\s　.,\-_'\"·・（）()\[\]｜|/\\]+", "")


def bare_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, trailing slash, query or fragment."""
    raw = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    rest = F.regexp_extract(F.regexp_replace(raw, r"^(https?:)?//", ""), r"^([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(rest, r"^www\.", ""), r"/+$", "")


def campaign_creator(url: Column) -> Column:
    """Host and creator of a campaign URL, where the platform's URLs carry one."""
    host = urls.domain_of(url)
    creator = F.regexp_extract(urls.path(url), r"/projects/([^/]+)/[^/]", 1)
    known = F.contains(host, F.lit("kickstarter.com")) | F.contains(host, F.lit("indiegogo.com"))
    return F.when(known & (creator != ""), F.concat(host, F.lit("/projects/"), creator))


def maker_keys(projects: DataFrame) -> DataFrame:
    """Ordered keys that say "same maker": ``id, position, key, source``.

    ``projects`` has maker_url, creator_url, official_url, maker_name, brand_name and
    campaign_url. Empty keys are never emitted.
    """
    host = F.substring_index(bare_url(F.col("official_url")), "/", 1)
    kinds = [
        ("url:", bare_url(F.col("maker_url")), "maker_url_or_creator_url"),
        ("url:", bare_url(F.col("creator_url")), "maker_url_or_creator_url"),
        ("host:", host, "official_site_host"),
        ("name:", bare_name(F.col("maker_name")), "maker_name"),
        ("name:", bare_name(F.col("brand_name")), "maker_name"),
        ("creator:", campaign_creator(F.col("campaign_url")), "campaign_creator"),
        ("campaign:", bare_url(F.col("campaign_url")), "campaign_url"),
    ]
    entries = F.array(*[F.struct(F.lit(p).alias("prefix"), v.alias("value"), F.lit(s).alias("source")) for p, v, s in kinds])
    rows = projects.select("id", F.posexplode(entries).alias("position", "k")).filter(F.coalesce("k.value", F.lit("")) != "")
    rows = rows.select("id", "position", F.concat("k.prefix", "k.value").alias("key"), "k.source")
    return rows.groupBy("id", "key").agg(F.min(F.struct("position", "source")).alias("f")).select("id", "f.position", "key", "f.source")


# --- quotas and samples ---------------------------------------------------------------------

def take_quotas(ordered: DataFrame, quotas: dict[str, int], stratum: str, order) -> DataFrame:
    """First rows of every stratum up to its quota.

    The largest quota is a literal, so both sides of the shuffle keep no more rows per
    stratum than that, however large a stratum is.
    """
    w = Window.partitionBy(stratum).orderBy(*order)
    quota = F.element_at(F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]), F.col(stratum))
    ranked = ordered.filter(F.col(stratum).isin(*quotas)).withColumn("place", F.row_number().over(w))
    return ranked.filter(F.col("place") <= max(quotas.values())).filter(F.col("place") <= quota)


def short_strata(rows: DataFrame, quotas: DataFrame, stratum: str) -> DataFrame:
    """Strata with fewer rows than their quota; must be empty."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    return quotas.join(sizes, stratum, "left").filter(F.coalesce("size", F.lit(0)) < F.col("quota"))


def allocate(sizes: DataFrame, target: int, stratum: str = "stratum") -> DataFrame:
    """Proportional shares by largest remainder, never above a stratum's size.

    ``sizes`` is one row per stratum. With the target at most the total, a floor plus
    one never exceeds a size, so one pass over the remainders is enough.
    """
    one = Window.partitionBy(F.lit(1))
    total = F.sum("size").over(one)
    goal = F.least(F.lit(target), total)
    raw = F.try_divide(F.col("size").cast("double"), total) * goal
    rows = sizes.withColumns({"raw": raw, "goal": goal}).withColumn("base", F.least(F.floor("raw"), F.col("size")))
    rest = F.col("goal") - F.sum("base").over(one)
    # equal remainders: the larger stratum first
    open_ = F.when(F.col("base") < F.col("size"), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(F.lit(1), open_).orderBy((F.col("raw") - F.col("base")).desc(), F.col("size").desc(), F.col(stratum)))
    rows = rows.withColumns({"rest": rest, "open": open_, "place": place})
    return rows.select(stratum, "size", (F.col("base") + F.when((F.col("open") == 0) & (F.col("place") <= F.col("rest")), 1).otherwise(0)).alias("share"))


def balanced_sample(rows: DataFrame, n: int, stratum: str, has_url: str, row_id: str = "id", seed: int = 0) -> DataFrame:
    """``n`` rows per stratum in the order of the MD5 of id and seed, at least one with and one without a URL
    when both exist and n is at least two."""
    hashed = rows.withColumn("draw", F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")).cast("binary")))
    side = F.coalesce(F.trim(F.col(has_url)) != "", F.lit(False))
    first = F.row_number().over(Window.partitionBy(stratum, "side").orderBy("draw", row_id))
    # a row behind n others of its own side cannot be drawn
    hashed = hashed.withColumn("side", side).withColumn("in_side", first).filter(F.col("in_side") <= n)
    must = F.when((F.col("in_side") == 1) & F.lit(n >= 2), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(must, "draw", row_id))
    return hashed.withColumn("place", place).filter(F.col("place") <= n).drop("draw", "in_side")


# --- requeue --------------------------------------------------------------------------------

def placeholder_signals(campaign_url: Column, official_url: Column, email_domain: Column) -> Column:
    """Why a project without a campaign page looks like test data."""
    site = urls.business_url_reason(official_url)
    given = F.coalesce(official_url, F.lit("")) != ""
    reserved = (F.coalesce(email_domain, F.lit("")) != "") & urls.business_url_reason(F.concat(F.lit("https://"), email_domain)).isNotNull()
    found = F.array_compact(
        F.array(
            F.when(given & site.isNotNull(), F.concat(F.lit("official_site:"), site)),
            F.when(reserved, F.lit("email_domain:reserved")),
        )
    )
    return F.when(campaign_url.isNotNull(), F.array().cast("array<string>")).otherwise(found)


def research_seed(campaign_url: Column, maker_url: Column, official_url: Column) -> Column:
    """First usable starting point of a search."""
    ok = lambda u: (F.coalesce(u, F.lit("")) != "") & urls.business_url_reason(u).isNull()
    return F.when(ok(campaign_url), "campaign_url").when(ok(maker_url), "maker_url").when(ok(official_url), "official_site")


def requeue_candidates(outreach: DataFrame, projects: DataFrame, contacts: DataFrame, active: DataFrame, limit: int | None = None) -> DataFrame:
    """Projects with outreach rows and what keeps them out of a new search: one row per
    project with ``reason`` (NULL for the selected ones) and ``seed``.

    ``contacts(project_id, v2_status, primary_email, official_site_url)`` is the newest
    row per project, ``active(project_id)`` the projects with a running job.
    """
    ids = outreach.groupBy("project_id").agg(F.count(F.lit(1)).alias("outreach_rows"), F.array_sort(F.collect_set("outreach_status")).alias("statuses"))
    p = projects.select(F.col("id").alias("project_id"), "archived_at", "source_url", "source_site", "maker_url", F.lit(True).alias("exists"))
    rows = (
        ids.join(p, "project_id", "left").join(contacts, "project_id", "left")
        .join(active.select("project_id").distinct().withColumn("busy", F.lit(True)), "project_id", "left")
    )
    page = urls.campaign_url(F.col("source_url"), F.col("source_site"))
    domain = F.nullif(F.lower(F.regexp_extract(F.coalesce("primary_email", F.lit("")), r"@([^@]*)$", 1)), F.lit(""))
    rows = rows.withColumn("page", page)
    rows = rows.withColumns(
        {
            "signals": placeholder_signals(F.col("page"), F.col("official_site_url"), domain),
            "seed": research_seed(F.col("page"), F.col("maker_url"), F.col("official_site_url")),
        }
    )
    reason = (
        F.when(F.col("exists").isNull(), "no_project")
        .when(F.col("archived_at").isNotNull(), "archived")
        .when(F.col("v2_status") == "completed", "v2_completed")
        .when(F.size("signals") > 0, "dummy")
        .when(F.col("seed").isNull(), "no_seed")
        .when(F.col("busy"), "active_job")
    )
    rows = rows.withColumn("reason", reason)
    if limit is not None:
        # the first ids in order are a bounded top-k; everything after them is overflow
        chosen = rows.filter(F.col("reason").isNull()).select("project_id").orderBy("project_id").limit(limit)
        rows = rows.join(F.broadcast(chosen.withColumn("chosen", F.lit(True))), "project_id", "left")
        rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("chosen").isNull(), "over_limit").otherwise(F.col("reason"))).drop("chosen")
    return rows.select("project_id", "outreach_rows", "statuses", "seed", "reason")


# --- predictions ------------------------------------------------------------------------------

def prediction_snapshot(layers: DataFrame, evidence_cap: int | None = None) -> DataFrame:
    """``contact_layer(project_id, layer_rank, kind, value)`` to one row per project with
    unique values per kind in layer order, at most ``evidence_cap`` evidence URLs; projects
    without any signal drop out."""
    first = (
        layers.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
        .groupBy("project_id", "kind", F.lower(F.trim("value")).alias("folded"))
        .agg(F.min(F.struct("layer_rank", F.trim("value").alias("value"))).alias("f"))
    )
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("f")))), lambda x: x["value"])
    out = first.groupBy("project_id").agg(
        listed("email").alias("emails"), listed("site").alias("sites"), listed("form").alias("forms"), listed("social").alias("socials"),
        listed("person").alias("people"), (listed("evidence") if evidence_cap is None else F.slice(listed("evidence"), 1, evidence_cap)).alias("evidence_urls"),
    )
    signals = [F.size(c) for c in ("emails", "sites", "forms", "socials", "people")]
    return out.filter(sum(signals, F.lit(0)) > 0)

"""Writing side: merges that make a new snapshot, imports, repairs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import urls
from leadloom.functions.text import any_of, blank, html_to_text

# Collected columns, and those an empty incoming value must not erase.
COLLECTED = (
    "title", "source_site", "category", "description", "image_url", "video_url", "currency", "goal_amount",
    "raised_amount", "backers_count", "start_date", "end_date", "maker_name", "maker_url",
)
KEEP_IF_NULL = ("maker_name", "maker_url", "category", "start_date", "end_date")


def route_by_site(batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows for projects, rows for success cases, and rejects of neither."""
    site = F.coalesce(F.col("source_site"), F.lit(""))
    target, domestic = site.isin(*vocab.SALES_TARGET_SITES, "other"), site.isin(*vocab.SUCCESS_SITES)
    return batch.filter(target), batch.filter(domestic), batch.filter(~target & ~domestic)


def fold_batch(batch: DataFrame, order: str = "position") -> DataFrame:
    """One row per URL: the last item wins, protected columns keep their last value."""
    present = [c for c in COLLECTED if c in batch.columns]
    at = F.col(order)
    aggregates = [
        F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) if c in KEEP_IF_NULL else F.max_by(F.struct(c), at)[c].alias(c)
        for c in present
    ]
    return batch.filter(F.col("source_url").isNotNull()).groupBy("source_url").agg(*aggregates)


def upsert_by_url(projects: DataFrame, batch: DataFrame, order: str = "position") -> DataFrame:
    """New snapshot with a ``change`` column: created, updated or kept.

    Stored ids and statuses stay; new rows get no id here (``rank_within`` or the
    table format assigns them). Rows without a URL are always created.
    """
    folded = fold_batch(batch, order)
    present = [c for c in COLLECTED if c in batch.columns]
    incoming = folded.select("source_url", F.lit(True).alias("_hit"), *[F.col(c).alias("_" + c) for c in present])
    merged = projects.filter(F.col("source_url").isNotNull()).withColumn("_old", F.lit(True)).join(incoming, "source_url", "full")
    values = {}
    for c in present:
        new, old = F.col("_" + c), F.col(c)
        values[c] = F.when(F.col("_hit"), F.coalesce(new, old) if c in KEEP_IF_NULL else new).otherwise(old)
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_hit"), "updated").otherwise("kept")
    merged = merged.withColumns({**values, "change": change}).drop("_hit", "_old", *["_" + c for c in present])
    quiet = projects.filter(F.col("source_url").isNull()).withColumn("change", F.lit("kept"))
    loose = batch.filter(F.col("source_url").isNull()).select("source_url", *present).withColumn("change", F.lit("created"))
    out = merged.unionByName(quiet, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)
    touched = F.col("change").isin("created", "updated")
    if "description_clean" in projects.columns:
        out = out.withColumn("description_clean", F.when(touched, html_to_text(F.when(touched, F.col("description")))).otherwise(F.col("description_clean")))
    return out


def change_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def rebuild_descriptions(projects: DataFrame) -> DataFrame:
    return projects.withColumn("description_clean", html_to_text(F.col("description")))


def merge_enrichment(projects: DataFrame, details: DataFrame, fields=("maker_name", "category", "end_date", "maker_url")) -> DataFrame:
    """Fill only blank fields or fields an earlier enrichment wrote; an own value that
    can no longer be confirmed is cleared. Challenged pages change nothing.

    ``projects`` has ``provenance map<string,string>``; ``details(id, challenged, …)``.
    """
    d = details.select("id", "challenged", *[F.col(f).alias("_" + f) for f in fields])
    rows = projects.join(d, "id", "left")
    usable = F.coalesce(~F.col("challenged"), F.lit(False))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    prov = F.coalesce(F.col("provenance"), empty)
    values, notes, reasons = {}, [], []
    for f in fields:
        old, new = F.col(f), F.col("_" + f)
        own = F.map_contains_key(prov, f)
        may = usable & (blank(old.cast("string")) | own)
        values[f] = F.when(may & new.isNotNull(), new).when(may & own, F.lit(None)).otherwise(old)
        notes.append(F.when(may & new.isNotNull(), F.struct(F.lit(f).alias("key"), F.lit("detail_page").alias("value"))))
        reasons.append(F.when(usable & new.isNull(), F.struct(F.lit(f).alias("key"), F.lit("not_found").alias("value"))))
    challenged = F.when(F.col("challenged"), F.struct(F.lit("all").alias("key"), F.lit("challenged").alias("value")))
    fresh = F.map_from_entries(F.array_compact(F.array(*notes)))
    rows = rows.withColumns(
        {
            **values,
            "provenance": F.when(usable, fresh).otherwise(prov),
            "enrichment_reasons": F.map_from_entries(F.array_compact(F.array(*reasons, challenged))),
        }
    )
    return rows.drop("challenged", *["_" + f for f in fields])


# --- captures -------------------------------------------------------------------------------

def capture_content(captures: DataFrame) -> DataFrame:
    """Adds ``content``, ``content_type`` and ``content_hash``. Parts: html or text, then
    JSON-LD, mail links, phone links, links, meta values, and the text the markup lacks."""
    html, text = F.coalesce("html", F.lit("")), F.coalesce("text", F.lit(""))
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n")
    extra = F.when((html != "") & (text != "") & ~F.contains(html, text), text)
    parts = [
        F.when(html != "", html).otherwise(text), *[joined(F.col(c)) for c in ("json_ld", "mailtos", "tels", "links")],
        joined(F.map_values("meta")), extra,
    ]
    content = F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])
    return captures.withColumns(
        {
            "content": content,
            "content_type": F.when(html != "", "html").otherwise("text"),
        }
    ).withColumn("content_hash", content_hash(F.col("content")))


def content_hash(content: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " ")), 256)


def new_captures(captures: DataFrame, stored: DataFrame) -> DataFrame:
    """Captures whose content the project does not have yet, once each."""
    known = stored.select("project_id", "content_hash").distinct()
    return captures.dropDuplicates(["project_id", "content_hash"]).join(known, ["project_id", "content_hash"], "left_anti")


# --- repairs -----------------------------------------------------------------------------------

def missing_campaign_urls(projects: DataFrame, promoted: DataFrame) -> DataFrame:
    """Replacement URL for rows without a usable one: the promoted candidate's, else the
    first URL in the enrichment text whose host fits the site."""
    site = F.col("source_site")
    broken = projects.filter(
        site.isin(*vocab.SALES_TARGET_SITES) & urls.campaign_url_reason(F.col("source_url"), site).isNotNull()
    )
    fits = lambda u: any_of([(site == s) & urls.under_domain(urls.hostname(u), d) for s, d in vocab.CAMPAIGN_DOMAINS.items()])
    by_project = promoted.groupBy(F.col("project_id").alias("id")).agg(F.min_by("candidate_url", "candidate_id").alias("candidate_url"))
    listed = F.regexp_extract_all(F.coalesce("enrichment", F.lit("")), F.lit(r'"(http[^"\\]*)"'), F.lit(1))
    rows = broken.join(by_project, "id", "left").select(
        "id", "source_site", F.when(fits(F.col("candidate_url")), F.trim("candidate_url")).alias("a"), F.get(F.filter(listed, fits), 0).alias("b")
    )
    return rows.select(
        "id", F.coalesce("a", "b").alias("url"), F.when(F.col("a").isNotNull(), "candidate").when(F.col("b").isNotNull(), "enrichment").alias("origin")
    ).filter(F.col("url").isNotNull())


def misplaced(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of domestic-platform rows among projects, and the snapshot without them."""
    wrong = F.coalesce(F.col("source_site").isin(*vocab.SUCCESS_SITES), F.lit(False))
    return projects.filter(wrong).groupBy("source_site").agg(F.count(F.lit(1)).alias("n")), projects.filter(~wrong)


# the local part is taken whole, however long, so that no front of it is left standing
EMAIL_IN_TEXT = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}"


def redacted(rows: DataFrame, columns, free_text) -> DataFrame:
    """Fixed column order with addresses removed from free-text columns."""
    return rows.select(
        *[F.regexp_replace(c, EMAIL_IN_TEXT, "[redacted-email]").alias(c) if c in free_text else F.col(c) for c in columns]
    )


def export_csv(rows: DataFrame, path: str, columns, free_text=()) -> None:
    redacted(rows, columns, free_text).write.mode("error").option("header", True).csv(path)

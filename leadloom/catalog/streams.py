"""Streaming operators on the static tables: the same processors in one batch, the intake as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.catalog import query
from leadloom.domain import AS_OF, table, with_tables
from leadloom.operators.entities import new_table
from leadloom.streaming import state


LEGAL = " OR ".join(f"(r.state = '{s}' AND e.target IN ({', '.join(repr(t) for t in to)}))" for s, to in vocab.STATUS_TRANSITIONS.items())


@query(
    "strm01_status_changes",
    # one step for each event of a project, in order
    with_tables("status_events", then=f"""
    WITH e AS (SELECT id, project_id, CASE WHEN to_status = 'won' THEN 'contract_agreed' ELSE to_status END AS target,
      row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS n FROM status_events),
    r AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS from_status, CAST(NULL AS VARCHAR) AS to_status, false AS accepted, 'not_started' AS state FROM e
      UNION ALL
      SELECT r.project_id, e.n, e.id, r.state, e.target, ({LEGAL}), CASE WHEN {LEGAL} THEN e.target ELSE r.state END FROM r JOIN e ON e.project_id = r.project_id AND e.n = r.n + 1)
    SELECT project_id, event_id, from_status, to_status, accepted FROM r WHERE n > 0 AND from_status <> to_status""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def strm01(spark, sf):
    events = table(spark, sf, "status_events").select("id", "project_id", "to_status", "created_at")
    return state.status_history(events).select("project_id", "event_id", "from_status", "to_status", "accepted")


@query(
    "strm02_live_health",
    with_tables("scrape_runs", then="""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY started_at DESC, id DESC) AS rn, coalesce(error_kind, 'unknown') AS kind FROM scrape_runs WHERE status <> 'running' QUALIFY rn <= 20)
    SELECT site, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status <> 'success' AND kind = 'network') AS network_errors,
      count(*) FILTER (WHERE status <> 'success' AND kind = 'structure') AS structure_errors, arg_min(id, rn) AS last_run_id,
      bool_or(status <> 'success' AND kind = 'structure') AND NOT coalesce(arg_min(coalesce(finished_at, started_at), rn) FILTER (WHERE status = 'success')
        > arg_min(coalesce(finished_at, started_at), rn) FILTER (WHERE status <> 'success' AND kind = 'structure'), false) AS structure_change_suspected FROM r GROUP BY 1"""),
)
def strm02(spark, sf):
    rows = state.live_health(table(spark, sf, "scrape_runs"), 20)
    return rows.select("site", "total", "success", "network_errors", "structure_errors", "last_run_id", "structure_change_suspected")


@query(
    "strm03_stale_heartbeats",
    with_tables("beats", then=f"""
    WITH s AS (SELECT *, lead(seen_at) OVER (PARTITION BY job_id ORDER BY seen_at, status <> 'running') AS following FROM beats WHERE seen_at < TIMESTAMP '{AS_OF}')
    SELECT DISTINCT job_id, project_id, 'timed_out' AS status, seen_at + INTERVAL 90 SECOND AS at FROM s
    WHERE status = 'running' AND coalesce(following, TIMESTAMP '{AS_OF}') > seen_at + INTERVAL 90 SECOND"""),
)
def strm03(spark, sf):
    """Signs of life up to the present, landed in two lots, each read by a run of the stream that goes on from the one before. A last sign of
    a clock moves the time to the present."""
    folder = new_table(spark)
    beats = table(spark, sf, "beats").withColumn("seen_at", F.col("seen_at").cast("timestamp")).filter(F.col("seen_at") < F.lit(AS_OF).cast("timestamp"))
    middle, delay = F.lit("1998-01-01 00:00:00").cast("timestamp"), "10 minutes"
    clock = F.lit(AS_OF).cast("timestamp") + F.expr(f"INTERVAL {delay}")
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit(None).cast("long").alias("project_id"), F.lit("clock").alias("status"), clock.alias("seen_at"))
    for lot in (beats.filter(F.col("seen_at") < middle), beats.filter(F.col("seen_at") >= middle).unionByName(tick)):
        lot.write.mode("append").parquet(f"{folder}/beats")
        stream = spark.readStream.schema(beats.schema).parquet(f"{folder}/beats").withWatermark("seen_at", delay)
        out = state.stale_heartbeats(stream).writeStream.format("parquet").option("path", f"{folder}/stale").option("checkpointLocation", f"{folder}/progress")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/stale").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "strm04_unique_captures",
    "SELECT DISTINCT page_id % 5 AS project_id, sha256(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS content_hash FROM pages",
)
def strm04(spark, sf):
    from leadloom.sources.store import content_hash

    schema = spark.read.parquet(f"{sf}/pages.parquet").schema
    pages = spark.readStream.schema(schema).parquet(f"{sf}/pages.parque[t]")  # a file stream wants a pattern or a folder
    captured_at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    captures = pages.select((F.col("page_id") % 5).alias("project_id"), content_hash(F.col("html")).alias("content_hash"), captured_at.alias("captured_at"))
    folder = new_table(spark)
    state.intake(captures, f"{folder}/store", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return state.stored_captures(spark, f"{folder}/store").select("project_id", "content_hash")

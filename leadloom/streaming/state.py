"""Stateful processing: current status, source health, capture intake, stale jobs.

State is keyed (project, site, job), so it is spread like the keys. A micro-batch
hands a key its new rows as Arrow batches, which a processor reads one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadloom import vocab
from leadloom.functions.text import any_of
from leadloom.operators.entities import cut_lineage
from leadloom.operators.history import last_n

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_row_state(spark) -> None:
    """These processors keep several state variables per key, which needs the RocksDB
    state store; a store the deployer chose stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name, "HDFSBacked"):
        spark.conf.set(name, STATE_STORE)
    spark.streams.active  # noqa: B018  starts the state coordinator, which a static table needs too

# --- current status ------------------------------------------------------------------------

STATUS_OUTPUT = "project_id long, event_id long, from_status string, to_status string, accepted boolean, at long, late boolean"
FIRST_STATE = "not_started"


def step(state: str, to_status: str) -> tuple[str, bool] | None:
    """Target and legality of an event, None for one that repeats the state."""
    target = "contract_agreed" if to_status == "won" else to_status
    return None if target == state else (target, target in vocab.STATUS_TRANSITIONS.get(state, ()))


def project_of(key: tuple):
    """A null in a group key would turn the keys beside it into floats, so it is a flag of its own."""
    return None if key[0] else key[1]


class StatusTracker(StatefulProcessor):
    """Applies status events of one project in the order of (created_at, id).

    Events wait until the watermark has passed them, so neither the order of arrival nor the cut into micro-batches
    decides what follows. An illegal transition is reported and changes nothing, a repeated state says nothing. An event
    that comes after a later one was applied is reported as ``late`` and changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "status string, at long, id long")
        self.waiting = handle.getListState("waiting", "at long, id long, to_status string")
        self.armed = handle.getValueState("armed", "at long")

    def _state(self) -> tuple:
        return self.current.get() if self.current.exists() else (FIRST_STATE, None, None)

    def _arm(self, at: int) -> None:
        """One timer per project: at its earliest event that waits, in whole milliseconds after it."""
        if self.armed.exists():
            if self.armed.get()[0] <= at:
                return
            self.handle.deleteTimer(self.armed.get()[0])
        self.armed.update((at,))
        self.handle.registerTimer(at)

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["project_id", "event_id", "from_status", "to_status", "accepted", "at", "late"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, done_at, done_id = self._state()
        for batch in rows:  # one Arrow batch of the project at a time
            events = list(zip(batch["at"].tolist(), batch["id"].tolist(), batch["to_status"].tolist()))
            late = [e for e in events if done_at is not None and (e[0], e[1]) <= (done_at, done_id)]
            waiting = [e for e in events if done_at is None or (e[0], e[1]) > (done_at, done_id)]
            if waiting:
                self.waiting.appendList(waiting)
                self._arm(-(-min(e[0] for e in waiting) // 1000))
            yield self._out([(project_of(key), id, state, to_status, False, at, True) for at, id, to_status in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for event in self.waiting.get():
            (due if event[0] <= passed else later).append(tuple(event))
        state, at, id = self._state()
        out = []
        for at, id, to_status in sorted(due, key=lambda e: (e[0], e[1])):
            taken = step(state, to_status)
            if taken:
                target, legal = taken
                out.append((project_of(key), id, state, target, legal, at, False))
                state = target if legal else state
        self.current.update((state, at, id))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._arm(-(-min(e[0] for e in later) // 1000))
        yield self._out(out)

    def close(self) -> None:
        pass


def status_changes(events: DataFrame) -> DataFrame:
    """Stream of ``events(id, project_id, to_status, created_at)``, with a watermark on ``created_at``, to accepted and
    rejected changes."""
    use_row_state(events.sparkSession)
    key = [F.col("project_id").isNull().alias("none"), F.coalesce("project_id", F.lit(0)).cast("long").alias("project")]
    rows = events.select(*key, "id", "to_status", F.unix_micros("created_at").alias("at"), "created_at")
    found = rows.groupBy("none", "project").transformWithStateInPandas(
        statefulProcessor=StatusTracker(), outputStructType=STATUS_OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return found.withColumn("at", F.timestamp_micros("at"))


STATES = vocab.SALES_STATUSES
_STEP_ROWS = "project_id long, event_id long, at long, to_status string, before binary, part int, kind string"
_STEP_KIND = pa.schema([("project_id", pa.int64()), ("event_id", pa.int64()), ("at", pa.int64()), ("to_status", pa.string()), ("before", pa.binary()), ("part", pa.int32()), ("kind", pa.string())])


def _transitions() -> dict[str, np.ndarray]:
    """For each target the state after an event, by the number of the state before it."""
    table = {target: np.arange(len(STATES), dtype=np.uint8) for target in STATES}
    for source, targets in vocab.STATUS_TRANSITIONS.items():
        for target in targets:
            table[target][STATES.index(source)] = STATES.index(target)
    return table


class _Walk:
    """A partition of sorted events, read one after the other.

    A project that may have begun in an earlier partition has an unknown start, so it is walked from every start at once: ``states`` holds
    the state for each of them. Projects that begin here start at the first state, and hold one number."""

    def __init__(self, project, part) -> None:
        self.first = self.project = project
        self.part = part
        self.head = self.states = np.arange(len(STATES), dtype=np.uint8)

    def reach(self, project) -> None:
        if project != self.project:
            self.project, self.states = project, np.array([STATES.index(FIRST_STATE)], np.uint8)

    def apply(self, following: np.ndarray | None) -> None:
        if following is not None:  # an unknown target changes nothing
            self.states = following[self.states]
            if self.project == self.first:
                self.head = self.states

    def sums(self) -> list[tuple]:
        """The map from start to end state of the first project, and the end of the last one (one byte if its start is known)."""
        return [(self.first, None, None, None, bytes(self.head), self.part, "head"), (self.project, None, None, None, bytes(self.states), self.part, "tail")]


def _walked_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every event with the state before it, for each start that is possible, and the sums of each partition."""
    following, walk = _transitions(), None
    made = lambda rows: pa.RecordBatch.from_pylist([dict(zip(_STEP_KIND.names, r)) for r in rows], schema=_STEP_KIND)
    for batch in batches:
        rows = []
        for project, id, at, to_status, part in zip(*(batch.column(c).to_pylist() for c in ("project_id", "id", "at", "to_status", "part"))):
            if walk is None or walk.part != part:
                rows += walk.sums() if walk else []
                walk = _Walk(project, part)
            walk.reach(project)
            rows.append((project, id, at, to_status, bytes(walk.states), part, "event"))
            walk.apply(following.get(to_status))
        yield made(rows)
    if walk:
        yield made(walk.sums())


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start state of each partition's first project, from one row for each partition in order."""
    carried, state = (), STATES.index(FIRST_STATE)  # no project equals an empty tuple
    for batch in batches:
        parts, begins = [], []
        for part, first, head, last, tail in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "head", "last", "tail"))):
            begins.append(state if first == carried else STATES.index(FIRST_STATE))
            parts.append(part)
            state = head[begins[-1]] if last == first else tail[0]
            carried = last
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(begins, pa.int32())], names=["part", "begin"])


def status_history(events: DataFrame) -> DataFrame:
    """The changes of a whole table of events, however many a project has.

    Which state follows depends on all events before, but a run of events is a function from start state to end state,
    and such functions compose. Events are sorted over range partitions, which may cut a project anywhere, and each
    partition is walked once, from all start states where the start is unknown. A second scan over one row for each
    partition carries the states across; it is all that a task reads of every partition, and all that is broadcast.
    Events without a project belong to one project of their own.
    """
    target = F.when(F.col("to_status") == "won", F.lit("contract_agreed")).otherwise(F.col("to_status"))
    narrow = events.select("project_id", F.col("id"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), target.alias("to_status"))
    ordered = narrow.repartitionByRange("project_id", "at", "id").sortWithinPartitions("project_id", "at", "id")
    rows = cut_lineage(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_walked_parts, _STEP_ROWS))
    sums = rows.filter("kind <> 'event'").groupBy("part").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(name) for k, c, name in (("head", "project_id", "first"), ("head", "before", "head"), ("tail", "project_id", "last"), ("tail", "before", "tail"))]
    )
    begins = sums.coalesce(1).sortWithinPartitions("part").mapInArrow(_chained, "part int, begin int")
    names = F.array(*[F.lit(s) for s in STATES])
    found = rows.filter("kind = 'event'").join(F.broadcast(begins), "part")
    at = F.when(F.length("before") == 1, F.lit(1)).otherwise(F.col("begin") + 1)
    before = F.conv(F.hex(F.substring(F.col("before"), at, F.lit(1))), 16, 10).cast("int")
    found = found.withColumn("from_status", F.get(names, before)).filter(~F.col("from_status").eqNullSafe(F.col("to_status")))
    legal = F.col("to_status").isNotNull() & any_of([(F.col("from_status") == s) & F.col("to_status").isin(*t) for s, t in vocab.STATUS_TRANSITIONS.items()])
    return found.select("project_id", "event_id", "from_status", "to_status", legal.alias("accepted"), F.timestamp_micros("at").alias("at"))


def current_status(changes: DataFrame) -> DataFrame:
    """Latest accepted state per project of a written change log."""
    accepted = changes.filter("accepted")
    return accepted.groupBy("project_id").agg(F.max_by("to_status", F.struct("at", "event_id")).alias("status"))


# --- source health ---------------------------------------------------------------------------

HEALTH_OUTPUT = (
    "site string, total long, success long, network_errors long, structure_errors long, unknown_errors long, "
    "structure_change_suspected boolean, last_run_id long"
)


class RecentRuns(StatefulProcessor):
    """Keeps the newest N finished runs of one site and reports on them per batch."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "id long, status string, error_kind string, started_at timestamp, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["id", "status", "error_kind", "started_at", "at"]
        held = [pd.DataFrame(list(self.runs.get()), columns=columns)] if self.runs.exists() else []
        for batch in rows:
            # only N rows survive each step, so a long backlog never piles up
            held = [pd.concat([*held, batch[columns]], ignore_index=True).sort_values(["started_at", "id"], ascending=False).head(self.window)]
        recent = held[0]
        self.runs.put([tuple(r) for r in recent.itertuples(index=False)])
        ok = recent["status"] == "success"
        kind = recent["error_kind"].fillna("unknown")
        structure = ~ok & (kind == "structure")
        recovered = ok.any() and structure.any() and recent.loc[ok, "at"].iloc[0] > recent.loc[structure, "at"].iloc[0]
        yield pd.DataFrame(
            {
                "site": [key[0]], "total": [len(recent)], "success": [int(ok.sum())], "network_errors": [int((~ok & (kind == "network")).sum())],
                "structure_errors": [int(structure.sum())], "unknown_errors": [int((~ok & ~kind.isin(["network", "structure"])).sum())],
                "structure_change_suspected": [bool(structure.any() and not recovered)], "last_run_id": [int(recent["id"].iloc[0])],
            }
        )

    def close(self) -> None:
        pass


def finished_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") != "running").select(
        "id", "site", "status", "error_kind", "started_at", F.coalesce("finished_at", "started_at").alias("at")
    )


def live_health(runs: DataFrame, window: int = 20) -> DataFrame:
    """One row per site and micro-batch over the newest ``window`` finished runs."""
    use_row_state(runs.sparkSession)
    # a static backlog is cut to the rows that can matter before it meets the processor
    rows = finished_runs(runs) if runs.isStreaming else presift_runs(runs, window)
    return rows.groupBy("site").transformWithStateInPandas(
        statefulProcessor=RecentRuns(window), outputStructType=HEALTH_OUTPUT, outputMode="Update", timeMode="None"
    )


def presift_runs(runs: DataFrame, window: int = 20) -> DataFrame:
    """Newest ``window`` runs per site of a static backlog, before replaying it."""
    return last_n(finished_runs(runs), "site", [F.col("started_at").desc(), F.col("id").desc()], window).drop("rn")


# --- stale jobs --------------------------------------------------------------------------------

STALE_OUTPUT = "job_id long, project_id long, status string, at long"
_SIGN = np.dtype([("job", "<i8"), ("seen", "<i8"), ("project", "<i8"), ("has_project", "?"), ("stopped", "?")])


class HeartbeatWatch(StatefulProcessor):
    """The jobs of one bucket: a running sign of a job is good for ``stale_ms``, any other state ends the job. Silence longer
    than that is reported once, with the instant the job became stale.

    Signs wait until the watermark has passed them and are then read in order of time, so neither their order of arrival nor the cut into
    micro-batches decides what is reported. A sign that comes after that is late and changes nothing. The state holds running
    jobs and waiting signs only, and one timer: for the earliest sign that waits, or the first job to become stale.

    Signs lie in the state as packed arrays, one for each Arrow batch that brought them, and are judged as arrays: an entry of its
    own and a step of Python for every sign cost more than all the rest.
    """

    def __init__(self, stale_ms: int) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "done long, armed long")
        self.running = handle.getListState("running", "signs binary")
        self.waiting = handle.getListState("waiting", "signs binary")

    def _armed(self, at: int, armed: int | None) -> int:
        if armed is not None:
            if armed <= at:
                return armed
            self.handle.deleteTimer(armed)
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, armed = self.times.get() if self.times.exists() else (None, None)
        held, lots = armed, []
        for batch in rows:
            signs = np.zeros(len(batch), _SIGN)
            signs["job"], signs["seen"] = batch["job_id"].astype("int64"), batch["seen_ms"].astype("int64")
            signs["stopped"], signs["has_project"] = batch["status"] != "running", batch["project_id"].notna()
            signs["project"] = batch["project_id"].fillna(0).astype("int64")
            signs = signs if done is None else signs[signs["seen"] > done]
            if len(signs):
                lots.append((signs.tobytes(),))
                armed = self._armed(int(signs["seen"].min()), armed)
        if lots:
            self.waiting.appendList(lots)
        if armed != held:
            self.times.update((done, armed))
        yield pd.DataFrame([], columns=["job_id", "project_id", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        alive, waiting = (np.frombuffer(b"".join(r[0] for r in state.get()), _SIGN) for state in (self.running, self.waiting))
        due = waiting["seen"] <= now
        later = waiting[~due]
        # running jobs were seen before all signs that are due
        signs = np.concatenate([alive, waiting[due]])
        signs = signs[np.lexsort((signs["stopped"], signs["seen"], signs["job"]))]
        last = np.ones(len(signs), bool)
        last[:-1] = signs["job"][1:] != signs["job"][:-1]
        until = np.full(len(signs), now, np.int64)
        until[:-1] = np.where(last[:-1], now, signs["seen"][1:])
        silent = ~signs["stopped"] & (until - signs["seen"] > self.stale_ms)
        alive, stale = signs[last & ~signs["stopped"] & ~silent], signs[silent]
        for state, rows in ((self.waiting, later), (self.running, alive)):
            if len(rows):
                state.put([(rows.tobytes(),)])
            else:
                state.clear()
        following = [int(x.min()) for x in (later["seen"], alive["seen"] + self.stale_ms + 1) if len(x)]
        self.times.update((now, self._armed(min(following), None) if following else None))
        projects = pd.array(stale["project"], dtype="Int64")
        projects[~stale["has_project"]] = pd.NA
        yield pd.DataFrame({"job_id": stale["job"], "project_id": projects, "status": "timed_out", "at": stale["seen"] + self.stale_ms})

    def close(self) -> None:
        pass


def stale_heartbeats(beats: DataFrame, stale_seconds: int = 90, buckets: int = 256) -> DataFrame:
    """``beats(job_id, project_id, status, seen_at)`` with a watermark on ``seen_at``, to (job_id, project_id, status, at)
    of every job that fell silent. Signs without a job are nobody's and left out.

    A call into the state store costs more than the few signs of a job, so jobs share ``buckets`` keys by a hash of their id; the number
    is fixed for the life of a checkpoint and should grow with the jobs that run at a time."""
    use_row_state(beats.sparkSession)
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = beats.filter("job_id IS NOT NULL").select(bucket, "job_id", "project_id", "status", F.unix_millis("seen_at").alias("seen_ms"), "seen_at")
    found = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=HeartbeatWatch(stale_seconds * 1000), outputStructType=STALE_OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return found.withColumn("at", F.timestamp_millis("at"))


# --- capture intake -----------------------------------------------------------------------------

BUCKETS = 64


def unique_captures(captures: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream of captures without repeats of (project, content) inside the watermark."""
    return captures.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["project_id", "content_hash"])


def bucket_of(content_hash: str = "content_hash") -> Column:
    """The bucket of the store that a capture belongs to, by its content alone."""
    return F.pmod(F.xxhash64(F.col(content_hash)), F.lit(BUCKETS)).cast("int")


def stored_captures(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("bucket", "epoch")


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def intake(captures: DataFrame, path: str, checkpoint: str, delay: str = "1 day"):
    """Exactly-once intake: repeats inside the watermark are dropped by state, older ones by an anti-join with the store.

    The store has a folder for each bucket of content hashes, and in it one for each micro-batch. A micro-batch lists and
    reads the buckets that its own captures fall into; one that is replayed overwrites what it wrote and does not see it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["project_id", "content_hash"]).withColumn("bucket", bucket_of()).persist()
        try:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            folders = [f for f in (f"{path.rstrip('/')}/bucket={b}" for b in sorted(touched)) if _exists(spark, f)]
            unseen = fresh
            if folders:
                schema = "project_id long, content_hash string, bucket int, epoch long"
                stored = spark.read.schema(schema).option("basePath", path).parquet(*folders).filter(F.col("epoch") != epoch)
                unseen = fresh.join(stored.select("bucket", "project_id", "content_hash"), ["bucket", "project_id", "content_hash"], "left_anti")
            if touched:
                out = unseen.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                out.partitionBy("bucket", "epoch").parquet(path)
        finally:
            fresh.unpersist()

    return (
        unique_captures(captures, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    )

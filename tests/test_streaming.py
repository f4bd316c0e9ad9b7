"""Stateful operators on file streams, cut into micro-batches in several ways, against plain replays."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest

from leadloom import vocab
from leadloom.streaming import state

START = datetime(2024, 1, 1)
EVENTS = "project_id long, created_at timestamp, id long, to_status string"
BEATS = "job_id long, project_id long, status string, seen_at timestamp"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def replayed(spark, tmp_path, name, batches, schema, operator, time_column, delay="0 seconds"):
    """Result of ``operator`` over a file stream, one micro-batch of data after the other, each by a query that starts from the progress of the one before."""
    for part, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{part}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark(time_column, delay)
        out = operator(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-cp")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}").collect()


# status events


def expected_changes(events):
    state_of, out = {}, set()
    for pid, at, eid, status in sorted(events, key=lambda e: (-1 if e[0] is None else e[0], e[1], e[2])):
        target = "contract_agreed" if status == "won" else status
        current = state_of.get(pid, "not_started")
        if target == current:
            continue
        ok = target in vocab.STATUS_TRANSITIONS.get(current, ())
        out.add((pid, eid, current, target, ok, at))
        if ok:
            state_of[pid] = target
    return out


def random_events(n, seed=11, hot=3):
    rng = random.Random(seed)
    names = [*vocab.SALES_STATUSES, "won"]
    return [(1 if i % hot == 0 else rng.randint(2, 6), START + timedelta(minutes=rng.randint(0, 500)), i, rng.choice(names)) for i in range(n)]


def legal_walk(project, n, first_id, seed):
    """Events that mostly follow the transitions, so that states do change."""
    rng, state_now, out = random.Random(seed), "not_started", []
    for i in range(n):
        state_now = rng.choice(vocab.STATUS_TRANSITIONS[state_now])
        out.append((project, START + timedelta(seconds=i * 7), first_id + i, state_now if rng.random() < 0.9 else rng.choice(vocab.SALES_STATUSES)))
    return out


def changes(rows):
    return {(r["project_id"], r["event_id"], r["from_status"], r["to_status"], r["accepted"], r["at"]) for r in rows}


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_history_does_not_depend_on_the_partitions(spark, partitions):
    events = random_events(300) + legal_walk(7, 500, 1000, 1) + legal_walk(2**60 + 1, 90, 5000, 2) + legal_walk(None, 40, 9000, 3) + [(8, START, 7000, "no such state"), (8, START, 7001, "ready")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = state.status_history(spark.createDataFrame(events, EVENTS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert changes(rows) == expected_changes(events) and len(rows) == len(changes(rows))


def test_history_of_no_events(spark):
    assert state.status_history(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_equals_history_whatever_the_batches(spark, tmp_path):
    events = random_events(150, hot=4) + legal_walk(9, 60, 1000, 4)
    end = [(0, START + timedelta(days=2), 99_999, "not_started")]
    by_time = sorted(events, key=lambda e: e[1])
    shuffled = random.Random(5).sample(events, len(events))
    for name, batches, delay in (("one", [events, end], "0 seconds"), ("in_order", [by_time[:70], by_time[70:], end], "1 minute"), ("mixed", [shuffled[:50], shuffled[50:120], shuffled[120:], end], "1 day")):
        rows = replayed(spark, tmp_path / name, "out", batches, EVENTS, state.status_changes, "created_at", delay)
        assert not any(r["late"] for r in rows)
        assert changes(rows) == expected_changes(events)


def test_events_without_a_project_are_one_project(spark, tmp_path):
    events = [(None, START, 1, "ready"), (2**60 + 1, START, 2, "ready"), (None, START + timedelta(hours=1), 3, "contacted"), (0, START + timedelta(hours=2), 4, "ready"), (5, START + timedelta(days=2), 9, "not_started")]
    rows = replayed(spark, tmp_path, "out", [events], EVENTS, state.status_changes, "created_at")
    assert changes(rows) == expected_changes(events)


def test_a_late_event_changes_nothing(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(1, at(0), 1, "ready"), (1, at(60), 2, "contacted"), (2, at(61), 3, "not_started")], [(2, at(200), 9, "ready")], [(1, at(30), 4, "rejected"), (1, at(210), 5, "replied")], [(2, at(500), 8, "contacted")]]
    rows = replayed(spark, tmp_path, "out", batches, EVENTS, state.status_changes, "created_at", "2 hours")
    kept = {(r["event_id"], r["accepted"]) for r in rows if r["project_id"] == 1 and not r["late"]}
    assert kept == {(1, True), (2, True), (5, True)}
    assert [r["event_id"] for r in rows if r["late"]] in ([], [4])  # dropped with the watermark, or reported


def test_tracker_reports_a_late_event():
    """The processor by itself, with the store's values in memory."""

    class Value:
        def __init__(self):
            self.held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    import pandas as pd

    tracker = state.StatusTracker()
    tracker.current, tracker.armed = Value(), Value()
    tracker.current.update(("ready", 100, 7))
    (out,) = tracker.handleInputRows((False, 1), iter([pd.DataFrame({"at": [100, 50], "id": [7, 9], "to_status": ["contacted", "rejected"]})]), None)
    assert out[["event_id", "accepted", "late", "from_status"]].values.tolist() == [[7, False, True, "ready"], [9, False, True, "ready"]]
    assert tracker.current.get() == ("ready", 100, 7)


# heartbeats


def silences(beats, until, stale=90):
    """(job, project, instant) of every silence that a running sign is followed by."""
    by_job = defaultdict(list)
    for job, project, status, at in beats:
        by_job[job].append((at, status != "running", project))
    out = set()
    for job, signs in by_job.items():
        signs.sort(key=lambda s: s[:2])
        for n, (at, stopped, project) in enumerate(signs):
            following = signs[n + 1][0] if n + 1 < len(signs) else until
            if not stopped and (following - at).total_seconds() > stale:
                out.add((job, project, at + timedelta(seconds=stale)))
    return out


def random_beats(n, seed):
    rng = random.Random(seed)
    return [(rng.randint(1, 5), 10, rng.choice(["running"] * 5 + ["completed", "failed"]), START + timedelta(seconds=rng.randint(0, 400) * 10)) for _ in range(n)]


def test_silences_do_not_depend_on_the_batches(spark, tmp_path):
    until = START + timedelta(days=1)
    tick = [(0, 10, "clock", until)]
    beats = random_beats(160, 3)
    want = silences(beats, until)
    assert len(want) > 20
    by_time = sorted(beats, key=lambda b: b[3])
    cut = next(i for i in range(80, 160) if by_time[i][3] > by_time[i - 1][3])
    shuffled = random.Random(6).sample(beats, len(beats))
    for name, batches, delay in (("one", [[*beats, *tick]], "0 seconds"), ("in_order", [by_time[:cut], by_time[cut:], tick], "0 seconds"), ("mixed", [shuffled, tick], "2 days")):
        if delay != "0 seconds":
            batches = [*batches, [(0, 10, "clock", until + timedelta(days=3))]]
        rows = replayed(spark, tmp_path / name, "out", batches, BEATS, state.stale_heartbeats, "seen_at", delay)
        got = {(r["job_id"], r["project_id"], r["at"]) for r in rows}
        assert len(got) == len(rows) and all(r["status"] == "timed_out" for r in rows)
        assert got == want


def test_an_older_sign_does_not_renew(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, 10, "running", at(1000)), (2, None, "running", at(1000))], [(1, 10, "completed", at(900)), (2, None, "running", at(950)), (3, 10, "clock", at(1050))], [(3, 10, "clock", at(5000))], [(1, 10, "running", at(6000)), (3, 10, "clock", at(9000))]]
    rows = replayed(spark, tmp_path, "out", batches, BEATS, state.stale_heartbeats, "seen_at", "10 minutes")
    got = sorted((r["job_id"], r["project_id"], r["at"]) for r in rows)
    assert got == [(1, 10, at(1090)), (1, 10, at(6090)), (2, None, at(1090))]


class Kept:
    """A state variable that counts what is put into it."""

    def __init__(self):
        self.rows, self.entries = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0] if self.single else iter(self.rows)

    def update(self, value):
        self.rows = [value]

    def appendList(self, values):
        self.rows, self.entries = self.rows + list(values), self.entries + len(values)

    def put(self, values):
        self.rows, self.entries = list(values), self.entries + len(values)

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.made = {}

    def _state(self, name, single):
        self.made[name] = Kept()
        self.made[name].single = single
        return self.made[name]

    def getValueState(self, name, schema):
        return self._state(name, True)

    def getListState(self, name, schema):
        return self._state(name, False)

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def test_signs_are_kept_by_the_batch():
    """A key's signs cost calls of the state store by the batch, not one for each sign."""
    rng = random.Random(5)
    beats = [(rng.randint(1, 50), rng.choice([None, 7]), rng.choice(["running"] * 4 + ["failed"]), START + timedelta(seconds=10 * i)) for i in range(3000)]
    until = START + timedelta(days=2)
    watch, handle = state.HeartbeatWatch(90_000), Handle()
    watch.init(handle)
    ms = lambda at: round((at - datetime(1970, 1, 1)).total_seconds() * 1000)
    frame = pd.DataFrame([(j, p, s, ms(at)) for j, p, s, at in beats], columns=["job_id", "project_id", "status", "seen_ms"])
    got = []
    for begin, now in ((0, START + timedelta(seconds=9_000)), (1000, START + timedelta(seconds=19_005)), (2000, until)):
        lot = frame[begin : begin + 1000]
        list(watch.handleInputRows((0,), iter([lot[:500], lot[500:]]), None))
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self, now=now: ms(now)})()
        for out in watch.handleExpiredTimer((0,), clock, None):
            got += [(r.job_id, None if pd.isna(r.project_id) else r.project_id, datetime(1970, 1, 1) + timedelta(milliseconds=r.at)) for r in out.itertuples()]
    assert len(got) == len(set(got)) and set(got) == silences(beats, until)
    assert handle.made["waiting"].entries <= 9 and handle.made["running"].entries <= 3


# captures


def test_intake_keeps_a_capture_once(spark, tmp_path):
    rows = [(1, "h1", START), (1, "h1", START), (2, "h1", START), (1, "h2", START)]
    schema = "project_id long, content_hash string, captured_at timestamp"
    store, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    for later in (0, 0, 30, 60):  # the same captures again, and days later, when the state has forgotten them
        spark.createDataFrame([(p, h, at + timedelta(days=later)) for p, h, at in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        state.intake(stream, store, cp).trigger(availableNow=True).start().awaitTermination()
    got = state.stored_captures(spark, store)
    assert sorted((r["project_id"], r["content_hash"]) for r in got.collect()) == [(1, "h1"), (1, "h2"), (2, "h1")]


def test_intake_reads_touched_buckets_only(spark, tmp_path):
    schema = "project_id long, content_hash string, captured_at timestamp"
    store, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    spark.createDataFrame([(1, f"h{i}", START) for i in range(300)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state.intake(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, cp).trigger(availableNow=True).start().awaitTermination()
    one = spark.createDataFrame([(1, "h5", START)], schema).select(state.bucket_of().alias("b")).first()["b"]
    for folder in tmp_path.joinpath("out").glob("bucket=*"):  # a bucket that no capture falls into may even be unreadable
        if folder.name != f"bucket={one}":
            for file in folder.rglob("*.parquet"):
                file.write_bytes(b"broken")
    spark.createDataFrame([(1, "h5", START + timedelta(days=9)), (2, "h5", START + timedelta(days=9))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state.intake(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, cp).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{store}/bucket={one}").filter("content_hash = 'h5'").collect()
    assert sorted(r["project_id"] for r in rows) == [1, 2]

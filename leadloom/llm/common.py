"""Helpers the operators share: the folder all executors see, written intermediates, 64-bit hashes in numpy."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DRAWN = np.random.default_rng(20240229)
BYTE_CODES = DRAWN.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset a local session gets a folder of its own; a cluster must set it."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='leadloom-')}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/leadloom-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder is left to its owner
        pass


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, removed when the driver ends: cuts the lineage, and any executor can read it again.

    The shuffle files behind it are of no use then; Spark deletes them once the driver has collected its garbage, so it is asked to."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(held: dict, value, build):
    """``build(value)``, made once for a broadcast value in a Python worker. The value is held beside it, or a later one could get its id."""
    if id(value) not in held:
        held.clear()
        held[id(value)] = value, build(value)
    return held[id(value)][1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that all its bits depend on all bits of ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def released(run):
    """``run`` for ``mapInArrow``, which at its end gives Arrow's free memory back: Python workers wait for later tasks, and what they hold counts against those."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


class RollingHash:
    """Hashes of substrings of a byte string, each in constant time: a polynomial modulo 2**64 over random byte codes."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(RollingHash._powers) <= n:
            m = 1 << (n + 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("_powers", BASE), ("_inverses", BASE_INVERSE)):
                    steps = np.full(m, base, np.uint64)
                    steps[0] = 1
                    setattr(RollingHash, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_CODES[data] * RollingHash._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * RollingHash._inverses[start])

    def windows(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[k:] - self.sums[:-k]) * RollingHash._inverses[: len(self.sums) - k])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and the last ends; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes in ``column``, at least a row each."""
    _, offsets = string_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to

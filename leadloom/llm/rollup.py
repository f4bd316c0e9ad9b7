"""Token totals kept by deltas.

A change row is (op, key columns, n_tokens, old_n_tokens and, where a revision moves a document to other keys, old_<key>). Each
becomes signed rows: an insert adds a document and its tokens, a delete takes them away, a revision takes the old count away and adds
the new one. ``commit`` adds a batch's deltas, summed by key, as one folder named after the batch; it counts once
its ``_SUCCESS`` marker is there, so a batch sent again is left as it is, and a broken one is written anew. ``totals`` adds up what
is committed. ``compact`` folds all committed batches into one and remembers their names; its folders are named ``compact-``, and a batch that
is called so is refused.

Null counts are 0, null keys are a key of their own, repeated change rows count each (a change feed sends a change once per batch). Keys whose
documents are all gone are left out of the totals. An empty batch commits and adds nothing. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")


def signed(changes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, d_docs, d_tokens): one row per side of each change."""
    new = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    old = F.coalesce(F.col("old_n_tokens"), F.lit(0)).cast("long") if "old_n_tokens" in changes.columns else F.lit(0).cast("long")
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null"))))
    is_revision = F.col("op") == "revise"
    before = [F.when(is_revision, F.col(f"old_{k}")).otherwise(F.col(k)) if f"old_{k}" in changes.columns else F.col(k) for k in keys]
    added = F.struct(*[F.col(k).alias(k) for k in keys], F.lit(1).cast("long").alias("d_docs"), new.alias("d_tokens"))
    taken = F.struct(*[c.alias(k) for k, c in zip(keys, before)], F.lit(-1).cast("long").alias("d_docs"), (-F.when(is_revision, old).otherwise(new)).alias("d_tokens"))
    sides = F.when(F.col("op") == "insert", F.array(added)).when(F.col("op") == "delete", F.array(taken)).when(is_revision, F.array(taken, added)).otherwise(unknown)
    return changes.select(F.explode(sides).alias("side")).select("side.*")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def committed(spark: SparkSession, ledger: str) -> list[str]:
    """Names of the batch folders that count."""
    root = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(n for n in names if n.startswith("batch=") and _exists(spark, f"{ledger}/{n}/_SUCCESS"))


def commit(changes: DataFrame, ledger: str, batch: str, keys: tuple[str, ...] = KEYS) -> bool:
    """Adds a batch; False if it was committed before. One writer at a time."""
    spark = changes.sparkSession
    if not batch or not all(c.isalnum() or c in "-_" for c in batch):
        raise ValueError("a batch name has letters, digits, - and _ only")
    if batch.startswith("compact-"):
        raise ValueError("names that begin with compact- are those of compactions")
    if _exists(spark, f"{ledger}/batch={batch}/_SUCCESS") or batch in folded(spark, ledger):
        return False
    deltas = signed(changes, keys).groupBy(*keys).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
    deltas.write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
    return True


def folded(spark: SparkSession, ledger: str) -> set[str]:
    """Batches that the newest compaction holds."""
    held = [n for n in committed(spark, ledger) if n.startswith("batch=compact-")]
    newest = max(held, key=lambda n: int(n.rpartition("-")[2]), default=None)
    return {r["name"] for r in spark.read.parquet(f"{ledger}/names-{newest[6:]}").collect()} if newest else set()


def _live(spark: SparkSession, ledger: str) -> list[str]:
    done, names = folded(spark, ledger), committed(spark, ledger)
    held = sorted((n for n in names if n.startswith("batch=compact-")), key=lambda n: int(n.rpartition("-")[2]))
    return held[-1:] + [n for n in names if not n.startswith("batch=compact-") and n[6:] not in done]


def totals(spark: SparkSession, ledger: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n_docs, n_tokens) over all committed batches."""
    paths = [f"{ledger}/{n}" for n in _live(spark, ledger)]
    if not paths:
        return spark.createDataFrame([], ", ".join([*(f"{k} string" for k in keys), "n_docs long", "n_tokens long"]))
    rows = spark.read.option("recursiveFileLookup", True).parquet(*paths)
    return rows.groupBy(*keys).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).filter("n_docs != 0 or n_tokens != 0")


def compact(spark: SparkSession, ledger: str, keys: tuple[str, ...] = KEYS) -> None:
    """Sums the committed batches into one. The names it holds are written before its sums, so a broken attempt counts for nothing."""
    live = _live(spark, ledger)
    names = folded(spark, ledger) | {n[6:] for n in live if not n.startswith("batch=compact-")}
    if not live:
        return
    number = 1 + max((int(n.rpartition("-")[2]) for n in committed(spark, ledger) if n.startswith("batch=compact-")), default=0)
    spark.createDataFrame([(n,) for n in sorted(names)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/names-compact-{number}")
    rows = spark.read.option("recursiveFileLookup", True).parquet(*[f"{ledger}/{n}" for n in live])
    rows.groupBy(*keys).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.mode("overwrite").parquet(f"{ledger}/batch=compact-{number}")

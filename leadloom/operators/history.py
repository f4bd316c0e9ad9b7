"""Latest-row views and ranked histories.

"Newest row per key" is an aggregate (``max_by``), so each task keeps one row
per key before the shuffle and a key that owns a third of the history costs no
more than any other. Every column is an aggregate of its own: Spark drops those that
nobody reads, and with numbers, flags and times alone it aggregates by hashing,
where strings, arrays and structs make it sort the whole history first. "Newest N per
key" is a ``row_number`` filter, which Spark turns into a group limit on both sides of
the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from leadloom.functions.urls import lit_array


def both(rows: DataFrame, first: Column, second: Column) -> Column:
    """Order by ``first``, then ``second``, NULL lowest; one decimal for times and whole numbers, else a struct."""
    a, b = (f.dataType for f in rows.select(first.alias("a"), second.alias("b")).schema)
    if isinstance(a, TimestampNTZType):  # no clock of the session comes into it
        day = F.unix_date(first.cast("date")).cast("long")
        first = (day * 86_400 + F.hour(first) * 3_600 + F.minute(first) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), first) * 1_000_000).cast("long")
    elif isinstance(a, TimestampType):
        first = F.unix_micros(first)
    elif isinstance(a, DateType):
        first = F.unix_date(first)
    elif not isinstance(a, ByteType | ShortType | IntegerType):
        return F.struct(first, second)
    if not isinstance(b, ByteType | ShortType | IntegerType | LongType):
        return F.struct(first, second)
    wide = lambda c: c.cast("decimal(20,0)")
    low = F.coalesce(wide(second) + F.lit(Decimal(2**63 + 1)), F.lit(Decimal(0)))  # 0 to 2^64
    return F.coalesce(wide(first), F.lit(Decimal(-5 * 10**18))) * F.lit(Decimal(2**64 + 1)) + low


def coded(value: Column, values) -> Column:
    """Place of ``value`` among ``values`` from 1, 0 for any other; NULL stays."""
    return F.array_position(lit_array(values), value)


def decoded(code: Column, values) -> Column:
    return F.get(lit_array(values), code.cast("int") - 1)


def _newest(rows: DataFrame, key: str, order: Column, columns) -> DataFrame:
    kept = rows.select(F.col(key), order.alias("_order"), *(columns or [c for c in rows.columns if c != key]))
    return kept.groupBy(key).agg(*[F.max_by(c, "_order").alias(c) for c in kept.columns[2:]])


def latest_by_id(
    history: DataFrame, key: str = "project_id", row_id: str = "id", where=None, columns=None
) -> DataFrame:
    """Row with the largest id per key, optionally among the rows passing ``where``."""
    rows = history if where is None else history.filter(where)
    return _newest(rows.filter(F.col(key).isNotNull()), key, F.col(row_id), columns)


def latest_by_time(
    history: DataFrame,
    key: str = "project_id",
    time: str = "created_at",
    row_id: str = "id",
    where=None,
    columns=None,
) -> DataFrame:
    """Newest row per key by time, then id."""
    rows = history if where is None else history.filter(where)
    return _newest(rows.filter(F.col(key).isNotNull()), key, both(rows, F.col(time), F.col(row_id)), columns)


def join_latest(entities: DataFrame, history: DataFrame, prefix: str, columns, **kw) -> DataFrame:
    """Left join every entity to its newest history row."""
    newest = latest_by_id(history, columns=columns, **kw).select(
        F.col("project_id").alias("id"), *[F.col(c).alias(prefix + c) for c in columns]
    )
    return entities.join(newest, "id", "left")


def last_n(history: DataFrame, key, order, n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key in the given order, with their position."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return history.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def history_listing(
    history: DataFrame, n: int, key: str = "project_id", time: str = "created_at", row_id: str = "id"
) -> DataFrame:
    """Newest ``n`` entries of every key, newest first."""
    return last_n(history, key, [F.col(time).desc(), F.col(row_id).desc()], n)


def top_k(rows: DataFrame, order, k: int, rank: str = "rank") -> DataFrame:
    """Global top k with its position. The ranking window only sees k rows."""
    best = rows.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def first_per_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """First row per key by position; rows with a NULL key are all kept."""
    others = [c for c in rows.columns if c != key]
    keyed = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*others), F.col(position)).alias("first"))
        .select(key, "first.*")
        .select(*rows.columns)
    )
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def best_per_key(rows: DataFrame, keys, rank, tie, columns) -> DataFrame:
    """Highest rank per key; on a tie the smallest ``tie`` value."""
    w = F.struct(rank.alias("r"), (-tie).alias("t"))
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), w).alias("best"))
        .select(*keys, "best.*")
    )


def round_robin(rows: DataFrame, group, within, row_id: str | None = "id") -> DataFrame:
    """Interleave groups: one row of each group per round, groups in name order.

    ``turn`` is the round and ``group_key`` the group; ordering by both gives the
    interleaved sequence. ``row_id`` tells the rows apart, None if no column does.
    """
    from leadloom.operators.entities import rank_within

    key = F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("None")) for g in group])
    return rank_within(rows.withColumn("group_key", key), ["group_key"], within, "turn", row_id)

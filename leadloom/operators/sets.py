"""Set operators on rows and on arrays of one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions.urls import lit_array


def union_ids(*parts: DataFrame) -> DataFrame:
    """Distinct ids of overlapping row sets."""
    return reduce(DataFrame.unionByName, [p.select("id") for p in parts]).distinct()


def confusion(expected: Column, predicted: Column, plausible: Column | None = None) -> dict[str, Column]:
    """True positives, false positives (without plausible ones) and misses of one row."""
    wrong = F.array_except(predicted, expected)
    if plausible is not None:
        wrong = F.array_except(wrong, F.coalesce(plausible, F.array().cast("array<string>")))
    return {
        "tp": F.array_intersect(expected, predicted),
        "fp": wrong,
        "fn": F.array_except(expected, predicted),
    }


def best_candidate(rows: DataFrame, keys, level: Column, levels, row_id: str, source: str) -> DataFrame:
    """Best row per key by a named level (first is best), collecting all sources."""
    rank = -F.array_position(lit_array(levels), level)
    return rows.groupBy(*keys).agg(
        F.max_by(F.col(row_id), F.struct(rank.alias("r"), (-F.col(row_id)).alias("i"))).alias(row_id),
        F.array_sort(F.collect_set(source)).alias("sources"),
    )


def merge_socials(layers: DataFrame) -> DataFrame:
    """``(project_id, layer_rank, platform, url)`` to the first non-empty URL per platform."""
    return (
        layers.filter(F.coalesce(F.col("url"), F.lit("")) != "")
        .groupBy("project_id", "platform")
        .agg(F.min_by("url", F.struct("layer_rank", "url")).alias("url"))
    )


def primary_social(merged: DataFrame) -> DataFrame:
    """One URL per project in preference order, any other platform after those."""
    position = F.array_position(lit_array(vocab.SOCIAL_PREFERENCE), F.col("platform"))
    rank = F.when(position == 0, len(vocab.SOCIAL_PREFERENCE) + 1).otherwise(position)
    return merged.groupBy("project_id").agg(
        F.min_by("url", F.struct(rank.alias("r"), F.col("platform"))).alias("primary_social_url")
    )


def new_versus_known(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Addresses not stored for the project yet, and how many were known."""
    key = F.lower(F.col("email"))
    known = stored.select("project_id", key.alias("email_key")).distinct().withColumn("known", F.lit(True))
    rows = found.withColumn("email_key", key).dropDuplicates(["project_id", "email_key"])
    return (
        rows.join(known, ["project_id", "email_key"], "left")
        .groupBy("project_id")
        .agg(
            F.count_if(F.col("known").isNull()).alias("new_count"),
            F.count_if(F.col("known")).alias("known_count"),
            F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("email_key")))).alias("new_emails"),
        )
    )

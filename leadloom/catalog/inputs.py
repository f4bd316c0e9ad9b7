"""Nested columns the operators expect, built from the flat domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.domain import CHANNELS, table


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "projects")


def contacts(spark, sf) -> DataFrame:
    rows = table(spark, sf, "contacts")
    one = F.array(F.struct(F.col("found_email").alias("email"), F.lit(70).alias("score")))
    return rows.withColumns(
        {
            "discovered_emails": F.when(F.col("found_email").isNotNull(), one),
            "discovered_forms": F.lit(None).cast("array<string>"),
        }
    )


def japan_checks(spark, sf) -> DataFrame:
    rows = table(spark, sf, "japan_checks")
    entries = [
        F.struct(
            F.lit(k).alias("channel"),
            F.lit(k).alias("label"),
            F.col(f"ch_{k}").alias("status"),
            F.lit(f"https://search.{k}.jp/").alias("search_url"),
            F.lit("").alias("note"),
        )
        for k in CHANNELS
    ]
    return rows.withColumn("channels", F.array(*entries)).drop(*[f"ch_{k}" for k in CHANNELS])


def summary_sources(spark, sf) -> dict[str, DataFrame]:
    return {
        "contacts": contacts(spark, sf),
        "japan_checks": japan_checks(spark, sf),
        "researches": table(spark, sf, "researches"),
        "people": table(spark, sf, "people"),
        "success_cases": table(spark, sf, "success_cases"),
    }


def joined(column: str):
    return F.array_join(F.col(column), ",").alias(column)


def text(column: str):
    return F.col(column).cast("string").alias(column)

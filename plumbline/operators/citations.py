"""Tiers of cited sources, and verdicts that depend on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[no trusted source]"


def tiers(citations: DataFrame, trusted: dict[int, Sequence[str]]) -> DataFrame:
    """citations (idx, url) with the best tier whose domains the url contains; 3 without any."""
    rows = [(d, t) for t, domains in trusted.items() for d in domains]
    table = citations.sparkSession.createDataFrame(rows, "domain string, tier int")
    met = citations.join(F.broadcast(table), F.lower("url").contains(F.col("domain")), "left")  # a configured list
    return met.groupBy("idx", "url").agg(F.coalesce(F.min("tier"), F.lit(3)).alias("tier"))


def downgraded(verdicts: DataFrame, tiered: DataFrame) -> DataFrame:
    """Verdicts whose citations have no tier under 3 become uncertain, with a mark that keeps the first verdict."""
    best = tiered.groupBy("idx").agg(F.min("tier").alias("tier"))
    rows = verdicts.join(best, "idx", "left").withColumn("tier", F.coalesce("tier", F.lit(3)))
    low = (F.col("tier") > 2) & (F.col("verdict") != "uncertain")
    return rows.withColumn("note", F.when(low, F.concat(F.lit(MARK + " was "), F.col("verdict")))).withColumn("verdict", F.when(low, "uncertain").otherwise(F.col("verdict")))


def restored(verdicts: DataFrame, tiered: DataFrame) -> DataFrame:
    """After a change of the trusted list: marked verdicts that now have a tier under 3 get their first verdict back."""
    best = tiered.groupBy("idx").agg(F.min("tier").alias("new_tier"))
    rows = verdicts.join(best, "idx", "left")
    back = F.col("note").startswith(MARK) & (F.coalesce("new_tier", F.lit(3)) <= 2)
    was: Column = F.regexp_extract("note", r" was (\w+)$", 1)
    return rows.withColumn("verdict", F.when(back, was).otherwise(F.col("verdict"))).withColumn("note", F.when(~F.coalesce(back, F.lit(False)), F.col("note"))).drop("new_tier")

"""Index membership as date intervals, `start <= d < end`, open end = NULL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.intervals import BUCKET, YEARS, cut


def _inside(day: Column, start: Column, end: Column) -> Column:
    return (start <= day) & (end.isNull() | (day < end))


def members_only(df: DataFrame, spells: DataFrame | None, date: str = "as_of") -> DataFrame:
    """Rows whose symbol was a member on the row's date. A semi-join, so overlapping spells cannot
    duplicate rows; its key is (symbol, year bucket), so a hot symbol is spread over its years. Without a spell table
    every row is kept."""
    if spells is None:
        return df
    s = cut(spells.select(F.col("symbol").alias("_s"), F.col("start").alias("_start"), F.col("end").alias("_end")), "_start", "_end")
    return df.join(s, (df["symbol"] == F.col("_s")) & (YEARS.of(df[date]) == F.col(BUCKET)) & _inside(df[date], F.col("_start"), F.col("_end")), "left_semi")


def member_counts(dates: DataFrame, spells: DataFrame, date: str = "as_of") -> DataFrame:
    """Open spells per date, dates without any included. Spells become +1/-1 steps that are summed per
    day first, so the running sum walks calendar days, never spells x dates."""
    real = spells.where("end is null or end > start")  # a spell that ends by its start covers no day
    steps = real.select(F.col("start").alias("_d"), F.lit(1).alias("_step")).unionByName(
        real.where("end is not null").select(F.col("end").alias("_d"), F.lit(-1).alias("_step"))
    )
    daily = steps.groupBy("_d").agg(F.sum("_step").alias("_step"))
    asked = dates.select(F.col(date).alias("_d")).distinct()
    timeline = daily.select("_d", "_step", F.lit(False).alias("_asked")).unionByName(asked.select("_d", F.lit(0).cast("long").alias("_step"), F.lit(True).alias("_asked")))
    w = Window.partitionBy(F.lit(0)).orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return timeline.select(F.col("_d").alias(date), F.sum("_step").over(w).alias("members"), "_asked").where("_asked").drop("_asked")


def removed_members(spells: DataFrame, known: DataFrame, min_year: int = 2009) -> DataFrame:
    """Symbols that left since `min_year` and that `known` has no data for."""
    left = spells.where(F.col("end") >= F.make_date(F.lit(min_year), F.lit(1), F.lit(1))).select("symbol").distinct()
    return left.join(known.select("symbol"), "symbol", "left_anti")


def tracked_symbols(spells: DataFrame, known: DataFrame, min_year: int = 2009) -> DataFrame:
    return known.select("symbol").union(removed_members(spells, known, min_year)).distinct()


def coverage(scores: DataFrame, spells: DataFrame) -> DataFrame:
    """Scored symbols over members per date."""
    scored = scores.groupBy("as_of").agg(F.count_distinct("symbol").alias("scored"))
    counts = member_counts(scored, spells)
    return scored.join(counts, "as_of").where("members > 0").select("as_of", "scored", "members", (F.col("scored") / F.col("members")).alias("coverage"))


def coverage_summary(cov: DataFrame) -> DataFrame:
    return cov.agg(
        F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"),
        F.min_by("as_of", F.struct("coverage", "as_of")).alias("min_as_of"), F.max_by("coverage", "as_of").alias("latest_coverage"),
    )


def eligible_lenient(df: DataFrame, universe: DataFrame | None) -> DataFrame:
    """Drops only symbols *known* to be something other than an equity."""
    if universe is None:
        return df
    return df.join(universe.where("quote_type is not null and quote_type <> 'EQUITY'").select("symbol"), "symbol", "left_anti")


def eligible_strict(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Keeps only symbols known to be equities."""
    return df.join(universe.where("quote_type = 'EQUITY'").select("symbol"), "symbol", "left_semi")

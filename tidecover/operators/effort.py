"""Fishing effort from position pings, by company and period, and catch per unit of effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seasons import iso_week, season_by_doy, season_type
from ..functions.text import vessel_code
from .regress import ols_many

PING_MINUTES = 9.0
LEAST_DAYS = 30


def season_of(day: Column) -> Column:
    """Season label of a day by the day-of-year windows: "1ra 2019"; null out of season."""
    tipo = season_by_doy(day)
    return F.when(tipo == "T1", F.concat(F.lit("1ra "), F.year(day).cast("string"))).when(tipo == "T2", F.concat(F.lit("2da "), F.year(day).cast("string")))


def clean_pings(pings: DataFrame, least_days: int = LEAST_DAYS) -> DataFrame:
    """vessel, day, season, pings: counts of the pings (code, ts, file_year, file_season) that belong to their file.

    A ping counts on a day of the file's season window in the file's year, whose season label it gets; seasons with pings on
    fewer than least_days days go.  Counted per vessel and day before anything is joined; rows without code or time go.
    """
    day = F.to_date("ts")
    own = pings.filter(F.col("code").isNotNull() & (season_by_doy(day) == season_type(F.col("file_season"))) & (F.year(day) == F.col("file_year")))
    daily = own.groupBy(vessel_code(F.col("code")).alias("vessel"), day.alias("day")).agg(F.count(F.lit(1)).alias("pings")).withColumn("season", season_of(F.col("day")))
    covered = daily.select("season", "day").distinct().groupBy("season").agg(F.count(F.lit(1)).alias("days")).filter(F.col("days") >= least_days)
    return daily.join(covered.select("season"), "season", "left_semi").select("vessel", "day", "season", "pings")


def owners(events: DataFrame) -> DataFrame:
    """vessel (normalised), company, since, until, n: who caught with a vessel, from the first to the last event of it."""
    named = events.filter("vessel is not null and company is not null and event_date is not null")
    return named.groupBy(vessel_code(F.col("vessel")).alias("vessel"), "company").agg(F.min("event_date").alias("since"), F.max("event_date").alias("until"), F.count(F.lit(1)).alias("n"))


def with_company(daily: DataFrame, owned: DataFrame) -> DataFrame:
    """daily (vessel, day, ...) with the company that had the vessel that day; vessels without any event go.

    Of companies whose time with the vessel holds the day the one with most events, else the one whose time is nearest;
    ties by name.  A vessel has a handful of owners, so the join gives a few rows for each day.
    """
    away = F.greatest(F.datediff("since", "day"), F.datediff("day", "until"), F.lit(0))
    each = daily.join(owned, "vessel").withColumn("_o", F.struct(away.alias("away"), (-F.col("n")).alias("n"), "company"))
    return each.groupBy(*daily.columns).agg(F.min("_o")["company"].alias("company"))


def match_rate(events: DataFrame, daily: DataFrame) -> DataFrame:
    """vessels, unmatched, rate: of the vessels with events those that have pings."""
    known = events.filter("vessel is not null").select(vessel_code(F.col("vessel")).alias("vessel")).distinct()
    lost = known.join(daily.select("vessel").distinct().withColumn("_has", F.lit(1)), "vessel", "left")
    total, found = F.count(F.lit(1)), F.count("_has")
    return lost.agg(total.alias("vessels"), (total - found).alias("unmatched"), (found / F.nullif(total, F.lit(0))).alias("rate"))


def unmatched_vessels(events: DataFrame, daily: DataFrame) -> DataFrame:
    return events.filter("vessel is not null").select(vessel_code(F.col("vessel")).alias("vessel")).distinct().join(daily.select("vessel").distinct(), "vessel", "left_anti")


def period_keys(day: Column, season: Column) -> Column:
    """Structs of level and period: the day, ISO week, month and season that a row counts in."""
    of = {"day": day.cast("string"), "week": iso_week(day), "month": F.date_format(day, "yyyy-MM"), "season": season}
    return F.array(*[F.struct(F.lit(level).alias("level"), period.alias("period")) for level, period in of.items()])


def effort_periods(owned_daily: DataFrame, minutes: float = PING_MINUTES) -> DataFrame:
    """level, company, period, hours, days: effort at every level in one pass, from daily counts."""
    per_day = owned_daily.groupBy("company", "day", "season").agg(F.sum("pings").alias("pings"))
    each = per_day.select("company", "pings", F.explode(period_keys(F.col("day"), F.col("season"))).alias("k"))
    return each.groupBy("k.level", "company", "k.period").agg((F.sum("pings") * F.lit(minutes / 60)).alias("hours"), F.count(F.lit(1)).alias("days"))


def catch_periods(events: DataFrame, xs: list[str], keys: list[str]) -> DataFrame:
    """level, keys, company, period, catch_tm and the mean of each x, of events in season, at every level in one pass."""
    own = events.filter("season is not null and company is not null")
    each = own.select(*keys, "company", "catch_tm", *xs, F.explode(period_keys(F.col("event_date"), F.col("season"))).alias("k"))
    return each.groupBy("k.level", *keys, "company", "k.period").agg(F.sum("catch_tm").alias("catch_tm"), *[F.avg(x).alias(x) for x in xs])


def catch_per_effort(catch: DataFrame, hours: DataFrame) -> DataFrame:
    """catch with hours, days and cpue: joined by level, company and period; periods without effort go."""
    return catch.join(hours, ["level", "company", "period"]).withColumn("cpue", F.col("catch_tm") / F.nullif(F.col("hours"), F.lit(0.0)))


def effort_model(cpue: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """The ladder of log(cpue) on xs: level, keys, term, n, coef, se, p, r2."""
    df = cpue.filter("cpue > 0").withColumn("y", F.log("cpue"))
    return ols_many(df, ["level", *keys], "y", xs)

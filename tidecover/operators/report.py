"""The tables of the reports, numbers only: percentiles by level, activated seasons with losses, pricing of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payouts import implied_loss, ramp
from ..functions.seasons import season_by_doy
from ..functions.stats import exact_percentiles
from ..functions.text import trigger_tag

SHARES = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p80": 0.8, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def by_level(daily: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, idx: daily values, monthly means, and means of each season (T1, T2) from daily (keys, time, idx)."""
    days = daily.select(*keys, F.lit("daily").alias("level"), "idx")
    months = daily.groupBy(*keys, F.trunc("time", "MM").alias("_m")).agg(F.avg("idx").alias("idx")).select(*keys, F.lit("monthly").alias("level"), "idx")
    named = daily.withColumn("level", season_by_doy(F.col("time"))).filter("level is not null")
    seasons = named.groupBy(*keys, F.year("time").alias("_y"), "level").agg(F.avg("idx").alias("idx")).select(*keys, "level", "idx")
    return days.unionByName(months).unionByName(seasons)


def percentile_table(daily: DataFrame, keys: list[str], shares: dict[str, float] = SHARES) -> DataFrame:
    """keys, level, n and the exact percentiles of each level of the index."""
    return exact_percentiles(by_level(daily, keys), [*keys, "level"], "idx", shares)


def with_beta(df: DataFrame, betas: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds beta of the row's region, or of the region that stands for it (aliases: region, stands_for); null if neither."""
    named = df.join(F.broadcast(aliases), "region", "left").withColumn("_of", F.coalesce("stands_for", "region"))
    return named.join(F.broadcast(betas.select(F.col("region").alias("_of"), "beta")), "_of", "left").drop("_of", "stands_for")


def activation_table(seasons: DataFrame, triggers: DataFrame, baselines: DataFrame, price: float) -> DataFrame:
    """region, year, tipo, idx, tag, loss, loss_tm, loss_money of the seasons at or over a region's p90.

    seasons has beta; triggers: region, p90, p95, p99; baselines: region, base_t1, base_t2.  tag names the triggers
    reached.  Seasons whose beta is null have no loss.
    """
    df = seasons.join(F.broadcast(triggers), "region").filter(F.col("idx") >= F.col("p90")).join(F.broadcast(baselines), "region")
    loss = implied_loss(F.col("idx"), F.col("beta"))
    tm = loss * F.when(F.col("tipo") == "T1", F.col("base_t1")).otherwise(F.col("base_t2"))
    return df.select("region", "year", "tipo", "idx", trigger_tag(F.col("idx"), F.col("p90"), F.col("p95"), F.col("p99")).alias("tag"), loss.alias("loss"), tm.alias("loss_tm"), (tm * price).alias("loss_money"))


def pricing_table(payouts: DataFrame, keys: list[str], price: float, loss_ratio: float) -> DataFrame:
    """keys, years, years_paid, aal, largest, cap, rate_on_line, pure_money, commercial_money of payouts (payout, cap)."""
    per = payouts.groupBy(*keys).agg(F.count(F.lit(1)).alias("years"), F.sum((F.col("payout") > 0).cast("long")).alias("years_paid"), F.avg("payout").alias("aal"), F.max("payout").alias("largest"), F.max("cap").alias("cap"))
    money = F.col("aal") * price
    return per.withColumns({"rate_on_line": F.col("aal") / F.nullif(F.col("cap"), F.lit(0.0)), "pure_money": money, "commercial_money": money / loss_ratio})


def seasonal_payouts(both: DataFrame, baselines: DataFrame) -> DataFrame:
    """scenario, region, year, cap_kind, exit_kind, pay1, pay2, payout, c1, c2 of seasons that each pay on their own.

    both: region, year, t1, t2; baselines: region with base_t1, base_t2 (mean catch) and max_t1, max_t2.  A season's entry
    (p90 or p95) and exit (p99, or its largest value) come from its own years.  The largest exit is not combined with the
    largest cap.
    """
    at = lambda t: F.percentile(t, [0.9, 0.95, 0.99, 1.0])
    pairs = both.groupBy("region").agg(at("t1").alias("q1"), at("t2").alias("q2"))
    kinds = [("p90", 0, "p99", 2, "mean"), ("p95", 1, "p99", 2, "mean"), ("p90", 0, "p99", 2, "max"), ("p95", 1, "p99", 2, "max"), ("p90", 0, "max", 3, "mean"), ("p95", 1, "max", 3, "mean")]
    of = lambda q, i: F.col(q)[i]
    variant = F.explode(F.array(*[F.struct(F.lit(name).alias("scenario"), F.lit(end).alias("exit_kind"), F.lit(cap).alias("cap_kind"), of("q1", e).alias("e1"), of("q1", x).alias("x1"), of("q2", e).alias("e2"), of("q2", x).alias("x2"), F.col("base_t1" if cap == "mean" else "max_t1").alias("c1"), F.col("base_t2" if cap == "mean" else "max_t2").alias("c2")) for name, e, end, x, cap in kinds]))
    variants = pairs.join(baselines, "region").select("region", variant.alias("v")).select("region", "v.*")
    df = both.join(F.broadcast(variants), "region")  # six rows a region
    pay = lambda t, i: F.least(F.col(f"c{i}") * ramp(F.col(t), F.col(f"e{i}"), F.col(f"x{i}")), F.col(f"c{i}"))
    return df.select("scenario", "region", "year", "cap_kind", "exit_kind", pay("t1", 1).alias("pay1"), pay("t2", 2).alias("pay2"), (pay("t1", 1) + pay("t2", 2)).alias("payout"), "c1", "c2")


def seasonal_rates(payouts: DataFrame, loss_ratio: float) -> DataFrame:
    """scenario, cap_kind, exit_kind, part (T1, T2, annual), aal, cap, pure_rate, commercial_rate of all regions together.

    A year's payouts are summed over regions and capped at the regions' caps before they are averaged.
    """
    keys = ["scenario", "cap_kind", "exit_kind"]
    years = payouts.groupBy(*keys, "year").agg(*[F.sum(c).alias(c) for c in ("pay1", "pay2", "c1", "c2")])
    part = lambda name, pay, cap: F.struct(F.lit(name).alias("part"), F.least(pay, cap).alias("pay"), cap.alias("cap"))
    a, b, c, d = (F.col(x) for x in ("pay1", "pay2", "c1", "c2"))
    each = years.select(*keys, F.explode(F.array(part("T1", a, c), part("T2", b, d), part("annual", a + b, c + d))).alias("p"))
    per = each.groupBy(*keys, "p.part").agg(F.avg("p.pay").alias("aal"), F.max("p.cap").alias("cap"))
    rate = F.col("aal") / F.nullif(F.col("cap"), F.lit(0.0))
    return per.withColumns({"pure_rate": rate, "commercial_rate": rate / loss_ratio})


def company_report(both: DataFrame, levels: DataFrame, catches: DataFrame, price: float) -> DataFrame:
    """company, region, scenario, years, years_paid, insured, aal, rate of every company at once; region Total sums them.

    both: region, year, t1, t2.  levels: region, scenario, entry, exit; each scenario has an entry of its own.  catches:
    company, region, mean_tm, its mean catch a year.  Insured is that catch in money; each season pays its share of it
    between entry and exit, a year no more than all.  A year's share is the same for all companies of a region, so companies
    meet the mean share, not the years.  The total counts no years.
    """
    each = both.join(F.broadcast(levels), "region")
    share = F.least(ramp(F.col("t1"), F.col("entry"), F.col("exit")) + ramp(F.col("t2"), F.col("entry"), F.col("exit")), F.lit(1.0))
    per = each.withColumn("s", share).groupBy("region", "scenario").agg(F.count(F.lit(1)).alias("years"), F.sum((F.col("s") > 0).cast("long")).alias("years_paid"), F.avg("s").alias("share"))
    rows = catches.join(F.broadcast(per), "region").withColumn("insured", F.col("mean_tm") * price)
    own = rows.select("company", "region", "scenario", "years", "years_paid", "insured", (F.col("insured") * F.col("share")).alias("aal"))
    none = F.lit(None).cast("bigint")
    total = own.groupBy("company", "scenario").agg(F.sum("insured").alias("insured"), F.sum("aal").alias("aal")).select("company", F.lit("Total").alias("region"), "scenario", none.alias("years"), none.alias("years_paid"), "insured", "aal")
    return own.unionByName(total).withColumn("rate", F.col("aal") / F.nullif(F.col("insured"), F.lit(0.0)))

"""Average losses, premiums and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payouts import ramp


def average_loss(payouts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, aal, share of the largest payout, years with and without a payout."""
    return payouts.groupBy(*keys).agg(F.avg("payout").alias("aal"), F.max("payout").alias("largest"), F.sum((F.col("payout") > 0).cast("int")).cast("long").alias("years_paid"), F.sum((F.col("payout") <= 0).cast("int")).cast("long").alias("years_unpaid")).withColumn("share", F.col("aal") / F.nullif(F.col("largest"), F.lit(0.0)))


def premiums(df: DataFrame, aal: Column, cap: Column, price: float, loss_ratio: float) -> DataFrame:
    """Adds rate on line, pure premium in tonnes and money, commercial premium and its rate."""
    return df.withColumns({"rate_on_line": aal / F.nullif(cap, F.lit(0.0)), "pure_tm": aal, "pure_money": aal * price, "commercial_money": aal * price / loss_ratio, "commercial_rate": aal / F.nullif(cap, F.lit(0.0)) / loss_ratio})


def activations(seasons: DataFrame, triggers: DataFrame, keys: list[str], below: bool = False) -> DataFrame:
    """keys, trigger, seasons, hits, share: seasons at or beyond each trigger (keys, trigger, level)."""
    hit = F.col("idx") <= F.col("level") if below else F.col("idx") >= F.col("level")
    df = seasons.join(triggers, keys).groupBy(*keys, "trigger").agg(F.count(F.lit(1)).alias("seasons"), F.sum(hit.cast("int")).cast("long").alias("hits"))
    return df.withColumn("share", F.col("hits") / F.col("seasons"))


def quotes(requests: DataFrame, baselines: DataFrame, index: DataFrame, actuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quotes of a whole table of requests at once, and their rows per season.

    requests: company, season (T1, T2 or both), entry, exit, limit (tonnes a season), price, loss_ratio.  baselines:
    company, tipo, baseline.  index: year, tipo, idx.  actuals: company, year, tipo, actual.
    """
    seasons = requests.join(baselines, "company").filter((F.col("season") == "both") | (F.col("season") == F.col("tipo")))
    pay = ramp(F.col("idx"), F.col("entry"), F.col("exit")) * F.least("baseline", "limit")
    rows = seasons.join(index, "tipo").withColumn("payout", pay).join(actuals, ["company", "year", "tipo"], "left")
    insured = seasons.groupBy("company", "season").agg(F.sum("baseline").alias("baseline"), F.sum(F.least("baseline", "limit")).alias("max_payout"), F.max("price").alias("price"), F.max("loss_ratio").alias("loss_ratio"))
    years = rows.groupBy("company", "season", "year").agg(F.sum("payout").alias("payout")).groupBy("company", "season").agg(F.avg("payout").alias("aal"))
    out = insured.join(years, ["company", "season"]).withColumns({"pure": F.col("aal") * F.col("price")}).withColumn("commercial", F.col("pure") / F.col("loss_ratio"))
    out = out.withColumns({"loading": F.col("commercial") - F.col("pure"), "rate": F.col("commercial") / F.nullif(F.col("max_payout") * F.col("price"), F.lit(0.0))})
    return out, rows


def basis_risk(rows: DataFrame) -> DataFrame:
    """Adds shortfall, uncovered loss and false trigger to rows with baseline, actual and payout."""
    short = F.greatest(F.col("baseline") - F.col("actual"), F.lit(0.0))
    return rows.withColumns({"shortfall": short, "uncovered": F.greatest(short - F.col("payout"), F.lit(0.0)), "false_trigger": (F.col("payout") > 0) & (short <= 0)})

"""Payout fractions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def ramp(x: Column, entry: Column, exit_: Column) -> Column:
    """From 0 at entry to 1 at exit_, rising; null where the two are equal is read as 0."""
    return F.when(F.abs(exit_ - entry) < 1e-9, F.lit(0.0)).otherwise(unit((x - entry) / F.nullif(exit_ - entry, F.lit(0.0))))


def ramp_below(x: Column, entry: Column, exit_: Column) -> Column:
    """The same for falling x: exit_ lies below entry."""
    return ramp(-x, -entry, -exit_)


def step(x: Column, trigger: Column) -> Column:
    return F.when(x >= trigger, 1.0).otherwise(0.0)


def step_below(x: Column, trigger: Column) -> Column:
    return F.when(x <= trigger, 1.0).otherwise(0.0)


def implied_loss(x: Column, beta: Column) -> Column:
    """1 - exp(beta x) for positive x, else 0."""
    return F.when(x > 0, 1 - F.exp(beta * x)).otherwise(0.0)


def implied_loss_below(x: Column, beta: Column) -> Column:
    return F.when(x < 0, 1 - F.exp(beta * x)).otherwise(0.0)


def annual(frac1: Column, frac2: Column, base1: Column, base2: Column) -> Column:
    """Each season pays on the whole year's baseline; the sum is capped at it."""
    whole = base1 + base2
    return F.least(whole * (frac1 + frac2), whole)


def seasonal(frac1: Column, frac2: Column, base1: Column, base2: Column) -> Column:
    """Each season pays on its own baseline and is capped at it."""
    return F.least(base1 * frac1, base1) + F.least(base2 * frac2, base2)

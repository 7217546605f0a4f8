"""Wide to long, derived columns, totals rows, first-seen rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONTHS


def _month(name: str) -> int | None:
    """As ``month_number``, for a column's name."""
    t = re.sub("[^A-Za-z]", "", name).lower()
    return next((k for k, m in enumerate(MONTHS, 1) if len(t) >= 3 and m.startswith(t)), None)


def melt(df: DataFrame, ids: list[str], periods: list[str]) -> DataFrame:
    """ids, period, period_month, value; nulls stay.  Months come from the columns' names, once."""
    long = [F.struct(F.lit(p).alias("period"), F.lit(_month(p)).cast("long").alias("period_month"), F.col(f"`{p}`").cast("double").alias("value")) for p in periods]
    return df.select(*[F.col(f"`{c}`") for c in ids], F.inline(F.array(*long)))


def derived(df: DataFrame, total: str, parts: list[str], within: float = 0.02, least: int = 3, share: float = 0.8) -> DataFrame:
    """compared, agree_share, is_derived: is ``total`` the sum of ``parts`` row by row?"""
    row_sum = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0.0)))
    d = df.where(F.col(total).isNotNull()).select((F.abs(row_sum - F.col(total)) <= F.abs(F.col(total)) * within).alias("ok"))
    a = d.agg(F.count("*").alias("compared"), F.avg(F.col("ok").cast("double")).alias("agree_share"))
    return a.select("*", ((F.col("compared") >= least) & (F.col("agree_share") >= share)).alias("is_derived"))


TOTALS = r"^\s*(grand\s+total|sub\s*-?total|total|sum|overall)\b"


def without_totals(df: DataFrame, label: str) -> DataFrame:
    """Rows but for those whose label begins with a word for a total."""
    return df.where(~F.coalesce(F.lower(F.col(label)).rlike(TOTALS), F.lit(False)))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; minima are pre-aggregated, so a hot key is no hot task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, *[F.col("x")[c].alias(c) for c in rest])

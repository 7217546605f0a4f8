"""A question's plan and its compilation to DataFrame operations.

One plan is one pass: filters before grouping, one aggregate with row and trace
counts, one order, one limit, so Catalyst pushes filters and columns into the
scan and turns order and limit into a top-k.  Years and months of a date column
are also asked for as ranges of dates, and values whose spellings are all known
as a list of these: a scan can leave out what lies outside.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryFailed, Unanswerable
from ..functions.scalars import departure, departure_band, in_months, month_number

AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}
#: A top-k keeps its rows in one heap, so larger limits are refused.
MOST_ROWS = 100_000
INTENTS = ("aggregate", "breakdown", "ranking", "trend", "lookup")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str  # = (any of the values, letters in either case), >, <, >=, <=
    values: tuple
    spelt: tuple = ()  # for "=": the spellings of the values that the column holds, all of them; without any, letters in either case are compared


@dataclass(frozen=True)
class TimeSpec:
    months: tuple[int, ...] = ()
    years: tuple[int, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    label: str = ""

    def __bool__(self) -> bool:
        return bool(self.months or self.years or self.year_from or self.year_to)


@dataclass(frozen=True)
class Normals:
    """What a plan's values are compared with: a measure of another table, aggregated as the plan's, for the same months.

    A sum over several years is compared as the mean of its years.
    """

    table: str
    measure: str
    keys: tuple[str, ...] = ()  # groups of the plan that the normals have too; one value for all without any
    period: str = "1991-2020"


@dataclass(frozen=True)
class Plan:
    intent: str
    measure: str
    aggregation: str = "sum"
    groups: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    time: TimeSpec = TimeSpec()
    descending: bool = True
    limit: int | None = 5000  # None: all rows; a limit is at most MOST_ROWS
    notes: tuple[str, ...] = field(default=())
    date: str | None = None  # the date that the table's year and month are parts of
    normals: Normals | None = None


def _known(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise QueryFailed(f"no column {name!r}")
    return F.col(f"`{name}`")


def _matches(df: DataFrame, f: Filter) -> Column:
    c = _known(df, f.column)
    if f.op == "=":
        if f.spelt:
            return c.isin(*f.spelt)
        if dict(df.dtypes)[f.column] == "string":
            return F.lower(c).isin(*[str(v).lower() for v in f.values])
        return c.isin(*f.values)
    low = {">": c.__gt__, "<": c.__lt__, ">=": c.__ge__, "<=": c.__le__}
    if f.op not in low:
        raise QueryFailed(f"no comparison {f.op!r}")
    return low[f.op](F.lit(f.values[0]))


#: More spans of dates than these become the one from the first to the last.
MOST_SPANS = 200


def spans(t: TimeSpec) -> list[tuple[dt.date | None, dt.date | None]]:
    """The dates that a time holds, as (first, first beyond), in order; None: no limit.  Months alone have none."""
    if not (t.years or t.year_from or t.year_to):
        return []
    if t.years:
        years = sorted(y for y in set(t.years) if (t.year_from or y) <= y <= (t.year_to or y))
    elif t.year_from and t.year_to:
        years = list(range(t.year_from, t.year_to + 1))
    else:
        return [(t.year_from and dt.date(t.year_from, 1, 1), t.year_to and dt.date(t.year_to + 1, 1, 1))]
    months, out = sorted(set(t.months)) or range(1, 13), []
    for y in years:
        for m in months:
            first, beyond = dt.date(y, m, 1), dt.date(y + m // 12, m % 12 + 1, 1)
            if out and out[-1][1] == first:
                out[-1] = (out[-1][0], beyond)
            else:
                out.append((first, beyond))
    return out if len(out) <= MOST_SPANS else [(out[0][0], out[-1][1])]


def _on(df: DataFrame, name: str, t: TimeSpec) -> Column | None:
    """The dates of a time, for the scan to prune by; the exact filter stands beside it."""
    kind, held, out = dict(df.dtypes).get(name), spans(t), None
    if kind not in ("date", "timestamp", "timestamp_ntz") or not held:
        return None
    for low, high in held:
        span = F.lit(True)
        if low:
            span = F.col(name) >= F.lit(low).cast(kind)
        if high:
            span = (span & (F.col(name) < F.lit(high).cast(kind))) if low else F.col(name) < F.lit(high).cast(kind)
        out = span if out is None else out | span
    return out


def _in_time(df: DataFrame, t: TimeSpec) -> list[Column]:
    out, kinds = [], dict(df.dtypes)
    if t.months:
        place = next((c for c in ("period_month", "month", "period") if c in kinds), None)
        if place is None:
            raise Unanswerable(f"the table has no month column, so {t.label or 'the months'} cannot be applied")
        c = F.col(place)
        out.append(in_months(c, t.months) if kinds[place] == "string" else c.isin(*t.months))
    if t.years or t.year_from or t.year_to:
        place = next((c for c in ("year", "period_year") if c in kinds), None)
        if place is None:
            raise Unanswerable(f"the table has no year column, so {t.label or 'the years'} cannot be applied")
        if t.years:
            out.append(F.col(place).isin(*t.years))
        if t.year_from:
            out.append(F.col(place) >= t.year_from)
        if t.year_to:
            out.append(F.col(place) <= t.year_to)
    return out


def _cut(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _compared(df: DataFrame, out: DataFrame, plan: Plan, normals: DataFrame | None) -> DataFrame:
    """With the columns normal, departure_pct and band; null where there is no normal.

    The table of normals shrinks to a row a key first; Spark broadcasts that if
    it is known to be small and shuffles it otherwise.
    """
    n = plan.normals
    if normals is None:
        raise QueryFailed(f"the table of normals {n.table!r} is not at hand")
    if not set(n.keys) <= set(plan.groups):
        raise QueryFailed("normals are compared by groups of the plan")
    for c in _in_time(normals, TimeSpec(months=plan.time.months, label=plan.time.label)):
        normals = normals.where(c)
    m = _known(normals, n.measure)
    one = AGGREGATES[plan.aggregation](m).cast("double").alias("normal")
    per = normals.where(m.isNotNull()).groupBy(*[_known(normals, k).alias(f"n_{k}") for k in n.keys]).agg(one) if n.keys else normals.where(m.isNotNull()).agg(one)
    joined = out.join(per, [F.col(f"`{k}`").eqNullSafe(F.col(f"n_{k}")) for k in n.keys], "left") if n.keys else out.crossJoin(per)  # one row
    p = departure(F.col("metric_value") / F.col("n_years"), F.col("normal"))
    kept = [c for c in out.columns if c != "n_years"]
    return joined.select(*[f"`{c}`" for c in kept], "normal", F.round(p, 1).alias("departure_pct"), departure_band(p).alias("band"))


def compile_plan(df: DataFrame, plan: Plan, normals: DataFrame | None = None) -> DataFrame:
    """The plan's rows: groups, metric_value, row_count, trace_rows, and for a plan with normals normal, departure_pct and band."""
    if plan.intent not in INTENTS or plan.aggregation not in AGGREGATES:
        raise QueryFailed(f"no plan {plan.intent!r} with {plan.aggregation!r}")
    if plan.limit is not None and not 0 < plan.limit <= MOST_ROWS:
        raise QueryFailed(f"a limit is from 1 to {MOST_ROWS}")
    m = _known(df, plan.measure)
    for f in plan.filters:
        df = df.where(_matches(df, f))
    if plan.date and (held := _on(df, plan.date, plan.time)) is not None:
        df = df.where(held)
    for c in _in_time(df, plan.time):
        df = df.where(c)
    if plan.intent == "lookup":
        return df.select(*[_known(df, g) for g in plan.groups], m.alias("metric_value")).limit(min(plan.limit or 200, 200))
    if plan.aggregation != "count":
        df = df.where(m.isNotNull())
    trace = F.count_if("is_trace") if "is_trace" in df.columns else F.lit(0).cast("long")
    measures = [AGGREGATES[plan.aggregation](m).alias("metric_value"), F.count("*").alias("row_count"), trace.alias("trace_rows")]
    year = next((c for c in ("year", "period_year") if c in df.columns), None)
    if plan.normals:
        if plan.aggregation == "count" or year in plan.normals.keys:
            raise QueryFailed("counts, and single years, have no normals")
        yearly = plan.aggregation == "sum" and year and year not in plan.groups
        measures.append((F.greatest(F.count_distinct(year), F.lit(1)) if yearly else F.max(F.lit(1))).alias("n_years"))
    groups = [_known(df, g) for g in plan.groups]
    out = df.groupBy(*groups).agg(*measures) if groups else df.agg(*measures)
    if plan.normals:
        out = _compared(df, out, plan, normals)
    if not groups:
        return out
    ties = [g.asc_nulls_last() for g in groups]
    if plan.intent == "trend":
        kinds = dict(df.dtypes)
        by = [(F.coalesce(month_number(F.col(g)), F.lit(99)) if kinds[g] == "string" and g in ("month", "period") else F.col(g)).asc_nulls_last() for g in plan.groups]
        return _cut(out.orderBy(*by, *ties), plan.limit)
    metric = F.col("metric_value")
    return _cut(out.orderBy(metric.desc_nulls_last() if plan.descending else metric.asc_nulls_last(), *ties), plan.limit)

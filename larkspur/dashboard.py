"""Charts of tables of one layout, ranked: one scan for all their key figures, one for all their series."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import profile

# The format of charts, how many of what they hold, and units that are averaged.
SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"
MOST_VALUES, MOST_CHARTS, MOST_MEASURES, MOST_DIMENSIONS = 24, 8, 6, 4
AVERAGED = ("degC", "percent", "hPa", "kmph")


@dataclass(frozen=True)
class Chart:
    chart_id: str
    title: str
    kind: str
    score: float
    table_id: str
    spec: dict
    caption: str

    def to_dict(self) -> dict:
        return asdict(self)


def spec(mark: str, rows: list[dict], x: str = "category", y: str = "value", x_type: str = "nominal") -> dict:
    sort = None if mark == "line" else "-y"
    return {"$schema": SCHEMA, "data": {"values": rows}, "mark": mark, "encoding": {"x": {"field": x, "type": x_type, "sort": sort}, "y": {"field": y, "type": "quantitative"}}}


def variation(values: list[float]) -> float:
    v = [x for x in values if x is not None]
    mean = sum(v) / len(v) if len(v) > 1 else 0.0
    return (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5 / abs(mean) if mean else 0.0


def series(df: DataFrame, measures: list[dict], dimensions: list[dict]) -> DataFrame:
    """table_id, dimension, measure, category, value, rank, of: the best ``MOST_VALUES`` categories of each pair of each table.

    Rows are expanded once per dimension and combined before the shuffle; ranks
    run within a pair over its categories. Times keep their order, others fall by value.
    """
    each = df.select("table_id", *[F.col(m["slug"]).cast("double").alias(f"m{k}") for k, m in enumerate(measures)], F.posexplode(F.array(*[F.col(d["slug"]).cast("string") for d in dimensions])).alias("d", "category"))
    how = [F.avg if m.get("unit") in AVERAGED else F.sum for m in measures]
    sums = each.groupBy("table_id", "d", "category").agg(*[h(f"m{k}").alias(f"m{k}") for k, h in enumerate(how)])
    long = sums.select("table_id", "d", "category", F.posexplode(F.array(*[F.col(f"m{k}") for k in range(len(measures))])).alias("m", "value")).where("value is not null")
    timed = F.col("d").isin(*[k for k, d in enumerate(dimensions) if d["role"] == "time"] or [-1])
    number = F.col("category").try_cast("double")
    w = Window.partitionBy("table_id", "d", "m").orderBy(F.when(timed, number).asc_nulls_last(), F.when(timed, F.col("category")), F.desc("value"), "category")
    # Spark cuts ranks before the shuffle, so no partition gets more than MOST_VALUES rows of each input partition
    return long.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= MOST_VALUES)


def layout(columns: list[dict]) -> tuple:
    """What tables whose charts are made together have in common."""
    return tuple((c["slug"], c["name"], c["role"], c["unit"], c["derived"]) for c in columns)


def charts(df: DataFrame, titles: dict[str, str], columns: list[dict]) -> list[Chart]:
    """Key figures and series of tables of one layout, unranked; df has their rows with ``table_id``, titles are by it."""
    measures = [c for c in columns if c["role"] == "measure" and not c["derived"]][:MOST_MEASURES]
    dimensions = [c for c in columns if c["role"] in ("dimension", "identifier", "time")][:MOST_DIMENSIONS]
    if not measures:
        return []
    by_slug, out = {m["slug"]: m for m in measures}, []
    for r in profile.measures(df, list(by_slug), ["table_id"]).collect():
        m, table = by_slug[r["measure"]], r["table_id"]
        if r["n"]:
            figures = {"kind": "kpi", "value": r["total"], "mean": r["mean"], "min": r["lo"], "max": r["hi"], "count": r["n"], "unit": m["unit"]}
            out.append(Chart(f"kpi_{table}_{m['slug']}", f"{m['name']} ({titles[table]})", "kpi", KPI_SCORE, table, figures, f"from {r['n']} values"))
    if not dimensions:
        return out
    got: dict[tuple[str, int, int], list] = {}
    for r in series(df, measures, dimensions).collect():
        got.setdefault((r["table_id"], r["d"], r["m"]), []).append(r)
    for (table, d, k), rows in sorted(got.items()):
        if len(rows) > 1:
            out.append(_chart(table, titles[table], measures[k], dimensions[d], [{"category": r["category"], "value": r["value"]} for r in sorted(rows, key=lambda r: r["rank"])]))
    return out


# Scores of a figure and of a series, and what spread, time and fulness add to the latter.
KPI_SCORE, SERIES_SCORE, SPREAD, TIMED, FULL = 0.35, 0.5, 0.3, 0.15, -0.1


def _chart(table: str, title: str, m: dict, dim: dict, rows: list[dict]) -> Chart:
    timed, full = dim["role"] == "time", len(rows) >= MOST_VALUES
    score = SERIES_SCORE + SPREAD * min(variation([r["value"] for r in rows]), 1.0) + TIMED * timed + FULL * full
    mark, held = ("line", "ordinal") if timed else ("bar", "nominal")
    return Chart(f"{mark}_{table}_{m['slug']}_{dim['slug']}", f"{m['name']} by {dim['name']}", mark, score, table, spec(mark, rows, x_type=held), f"{title}: {'the first' if full else 'all'} {len(rows)}")


def ranked(found: list[Chart], most: int = MOST_CHARTS) -> list[Chart]:
    """The best charts, each kind and title once."""
    first: dict[tuple[str, str], Chart] = {}
    for c in sorted(found, key=lambda c: (-c.score, c.chart_id)):
        first.setdefault((c.kind, c.title), c)
    return list(first.values())[: max(1, min(most, 24))]


def suggest(columns: list[dict]) -> list[dict]:
    """Charts worth asking for, from roles alone."""
    measures = [c for c in columns if c["role"] == "measure" and not c["derived"]]
    times = [c for c in columns if c["role"] == "time"]
    dims = [c for c in columns if c["role"] == "dimension"]
    out = [{"kind": "scatter", "x": a["slug"], "y": b["slug"], "reason": "two measures of one row"} for a, b in zip(measures, measures[1:])]
    out += [{"kind": "line", "x": t["slug"], "y": m["slug"], "reason": "a measure over time"} for m in measures[:2] for t in times[:1]]
    out += [{"kind": "pie", "x": d["slug"], "y": measures[0]["slug"], "reason": "few parts of a whole"} for d in dims if measures and 2 <= len(d["sample"]) <= 8]
    out += [{"kind": "bar", "x": "departure_pct", "y": m["slug"], "reason": "departure from normal"} for m in measures if m["unit"] == "mm"]
    return out[:8]

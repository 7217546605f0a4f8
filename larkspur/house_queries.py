"""Queries over a warehouse of files that Spark writes from the given tables, and SQL that gives the same rows.

The files are monthly sums of line items (wide), sums by flag, status and month
(long), and the customers, in three files of one layout.  All are ingested
together, found and typed like any other file; no number in them stands for a
missing value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dashboard
from .catalogue_queries import _MONTHS, _WIDE, _li, _rounded, _t, _wide
from .plans.plan import compile_plan
from .streaming import arrivals
from .warehouse import Warehouse

AS_OF = "2026-01-31"
_houses: dict[tuple[str, str], Warehouse] = {}


def _written(spark: SparkSession, df: DataFrame, folder: str, name: str) -> list[str]:
    """The paths of CSV files with these rows, one for each partition, named after ``name``."""
    df.write.option("header", True).csv(f"{folder}/parts_{name}")
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(x.getPath().toString()) for x in fs.listStatus(place(f"{folder}/parts_{name}")) if x.getPath().getName().startswith("part-"))
    out = [f"{folder}/{name}{f'_{k}' if len(parts) > 1 else ''}.csv" for k in range(len(parts))]
    for a, b in zip(parts, out):
        fs.rename(place(a), place(b))
    return out


def _flags(spark: SparkSession, d: str) -> DataFrame:
    li = _li(spark, d).groupBy("l_returnflag", "l_linestatus", "year", "period_month").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    return li.select(
        F.col("l_returnflag").alias("Flag"), F.col("l_linestatus").alias("Status"), F.col("year").alias("Year"), F.date_format(F.make_date(F.lit(2000), "period_month", F.lit(1)), "MMMM").alias("Month"),
        F.round("q", 2).alias("Quantity"), F.round("p", 2).alias("Revenue (t)"),
    )


def house(spark: SparkSession, d: str) -> Warehouse:
    """The warehouse, made once a session and folder, beside Spark's own."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _houses:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/larkspur-house-{uuid.uuid4().hex}"
        w = Warehouse(spark, f"{folder}/house")
        customers = _t(spark, d, "customer").select(F.col("c_custkey").alias("Customer id"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"), F.col("c_acctbal").alias("Balance"))
        early = _written(spark, _flags(spark, d).where("Year <= 1996").coalesce(1), f"{folder}/early", "flags")
        w.ingest_many(early, AS_OF, missing=())
        paths = _written(spark, _wide(spark, d).coalesce(1), folder, "monthly") + _written(spark, _flags(spark, d).coalesce(1), folder, "flags")  # sums, a few hundred rows whatever the table
        for done in w.ingest_many(paths + _written(spark, customers.repartitionByRange(3, "Customer id"), folder, "customers"), AS_OF, missing=()):
            if "error" in done:
                raise done["error"]
        _houses[key] = w
    return _houses[key]


def _of(w: Warehouse, filename: str) -> dict:
    return next(t for t in w.tables() if t["filename"] == filename)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _asked(question: str, filename: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a question's plan, resolved by the warehouse."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        w = house(spark, d)
        r = w.resolve(question, _of(w, filename)["table_id"])
        return _rounded(compile_plan(w.frame(r["table_id"]), r["plan"])).drop("trace_rows")

    return run


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """The rows of three files of one layout, read by one scan."""
    w = house(spark, d)
    return w._frames([t for t in w.tables() if t["filename"].startswith("customers")]).select(F.col("customer_id").cast("long").alias("customer_id"), "name", "segment", "balance")


def _tables(spark: SparkSession, d: str) -> DataFrame:
    w = house(spark, d)
    return _rows(spark, [(t["filename"], t["sheet"], t["kind"], t["cell_range"], t["row_count"], len(t["columns"])) for t in w.tables() if not t["filename"].startswith("customers")], "filename string, sheet string, kind string, cell_range string, row_count long, n_columns long")


def _columns(spark: SparkSession, d: str) -> DataFrame:
    w = house(spark, d)
    rows = [(t["filename"], c["slug"], c["role"], c["kind"], c["unit"], c["distinct"]) for t in (_of(w, "flags.csv"), _of(w, "monthly.csv")) for c in t["columns"]]
    return _rows(spark, rows, "filename string, slug string, role string, kind string, unit string, distinct_values long")


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    w = house(spark, d)
    p = w.profile(_of(w, "flags.csv")["table_id"])
    rows = [(m["measure"], m["n"], m["missing"], round(m["total"], 2), round(m["lo"], 2), round(m["hi"], 2), round(m["median"], 2)) for m in p["measures"]]
    return _rows(spark, rows, "measure string, n long, missing long, total double, lo double, hi double, median double")


def _topped(spark: SparkSession, d: str) -> DataFrame:
    w = house(spark, d)
    p = w.profile(_of(w, "flags.csv")["table_id"])
    return _rows(spark, [(slug, p["distinct"][slug], k, r["value"], r["n"]) for slug, rows in p["top"].items() for k, r in enumerate(rows, 1)], "slug string, distinct_values long, no int, value string, n long")


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Charts' series of the three customer files together."""
    w = house(spark, d)
    ts = [t for t in w.tables() if t["filename"].startswith("customers")]
    own = {c["slug"]: c for c in ts[0]["columns"]}
    s = dashboard.series(w._frames(ts).withColumn("table_id", F.lit("customers")), [own["balance"]], [own["segment"]])
    return s.select("category", F.round("value", 2).alias("value"), "rank")


_QUARTERS = "select l_returnflag as flag, l_linestatus as status, year(l_shipdate) as y, month(l_shipdate) as m, round(sum(l_quantity), 2) as q, round(sum(l_extendedprice), 2) as p from lineitem group by 1, 2, 3, 4"
_EACH = "with f as (" + _QUARTERS + ") "
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "house_tables": _tables,
    "house_files": lambda s, d: house(s, d).files().where("filename not like 'customers%'").select("filename", "tables", "rows"),
    "house_columns": _columns,
    "house_health": lambda s, d: _rows(s, [(h["datasets"], h["rows"]) for h in [house(s, d).health()]], "datasets long, rows long"),
    "house_versions": lambda s, d: _rows(s, [(x["status"], x["ingest_version"], x["row_count"]) for x in house(s, d).datasets() if x["filename"] == "flags.csv"], "status string, ingest_version long, row_count long"),
    "house_customers": _customers,
    "house_ask_monsoon": _asked("total monthly value in monsoon by year", "monthly.csv"),
    "house_ask_value": _asked("average revenue for flag r in july until september by status", "flags.csv"),
    "house_ask_ranking": _asked("top 3 years by quantity", "flags.csv"),
    "house_profile": _profiled,
    "house_top_values": _topped,
    "house_series": _series,
    "windowed_events": lambda s, d: arrivals.windowed(_t(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n"),
}
_MONTH_COLUMNS = [("year", "time", "long", None), *[("period", "dimension", "string", 12)], ("period_month", "time", "long", None), ("value", "measure", "double", None)]
ORACLES: dict[str, str] = {
    "house_tables": (
        "select 'monthly.csv' as filename, 'monthly' as sheet, 'table' as kind, 'A1:N' || (count(distinct year(l_shipdate)) + 1) as cell_range, 12 * count(distinct year(l_shipdate)) as row_count, cast(4 as bigint) as n_columns from lineitem union all "
        f"select 'flags.csv', 'flags', 'table', 'A1:F' || (count(*) + 1), count(*), cast(6 as bigint) from ({_QUARTERS})"
    ),
    "house_files": f"select 'monthly.csv' as filename, cast(1 as bigint) as tables, 12 * count(distinct year(l_shipdate)) as rows from lineitem union all select 'flags.csv', cast(1 as bigint), count(*) from ({_QUARTERS})",
    "house_columns": (
        _EACH + "select 'flags.csv' as filename, 'flag' as slug, 'dimension' as role, 'string' as kind, cast(null as varchar) as unit, count(distinct flag) as distinct_values from f union all "
        "select 'flags.csv', 'status', 'dimension', 'string', null, count(distinct status) from f union all select 'flags.csv', 'month', 'time', 'string', null, null union all select 'flags.csv', 'year', 'time', 'long', null, null union all "
        "select 'flags.csv', 'quantity', 'measure', 'double', null, null union all select 'flags.csv', 'revenue_t', 'measure', 'double', 'tonnes', null"
        + "".join(f" union all select 'monthly.csv', '{s}', '{r}', '{k}', null, {n or 'null'}" for s, r, k, n in _MONTH_COLUMNS)
    ),
    "house_health": f"select cast(5 as bigint) as datasets, (select 12 * count(distinct year(l_shipdate)) from lineitem) + (select count(*) from ({_QUARTERS})) + (select count(*) from customer) as rows",
    "house_versions": _EACH + "select 'active' as status, cast(2 as bigint) as ingest_version, count(*) as row_count from f union all select 'superseded', cast(1 as bigint), count(*) from f where y <= 1996",
    "house_customers": "select c_custkey as customer_id, c_name as name, c_mktsegment as segment, c_acctbal as balance from customer",
    "house_ask_monsoon": f"with w as ({_WIDE}) select cast(year as bigint) as year, round({' + '.join(f'coalesce(\"{m}\", 0)' for m in _MONTHS[5:9])}, 2) as metric_value, {' + '.join(f'cast(\"{m}\" is not null as bigint)' for m in _MONTHS[5:9])} as row_count from w",
    "house_ask_value": _EACH + "select status, round(avg(p), 2) as metric_value, count(*) as row_count from f where flag = 'R' and m in (7, 9) group by 1",
    "house_ask_ranking": _EACH + "select cast(y as bigint) as year, round(sum(q), 2) as metric_value, count(*) as row_count from f group by 1 order by sum(q) desc, 1 limit 3",
    "house_profile": _EACH + " union all ".join(f"select '{s}' as measure, count({c}) as n, count(*) - count({c}) as missing, round(sum({c}), 2) as total, min({c}) as lo, max({c}) as hi, round(median({c}), 2) as median from f" for s, c in (("quantity", "q"), ("revenue_t", "p"))),
    "house_top_values": _EACH + " union all ".join(
        f"select '{c}' as slug, cast((select count(distinct {c}) from f) as bigint) as distinct_values, cast(no as integer) as no, {c} as value, n from (select {c}, n, row_number() over (order by n desc, {c}) as no from (select {c}, count(*) as n from f group by 1)) where no <= 8" for c in ("flag", "status")
    ),
    "house_series": "select c_mktsegment as category, round(sum(c_acctbal), 2) as value, cast(row_number() over (order by sum(c_acctbal) desc, c_mktsegment) as integer) as rank from customer group by 1",
    "windowed_events": "select strftime(date_trunc('hour', cast(ts as timestamp)), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n from events group by 1, 2",
}

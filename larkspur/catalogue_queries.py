"""The table queries, each over its whole table, and SQL that gives the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicon, nlq
from .functions import scalars as S
from .operators import profile, reshape, search
from .plans.plan import Filter, Plan, TimeSpec, compile_plan
from .sources import ingest


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _li(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").withColumns({"year": F.year("l_shipdate"), "period_month": F.month("l_shipdate"), "is_trace": F.col("l_discount") == 0.0})


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").withColumns({"year": F.year("o_orderdate"), "period_month": F.month("o_orderdate")})


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("metric_value", F.round(F.col("metric_value").cast("double"), 2))


def _run(table, **plan):
    plan = {"limit": None, "intent": "aggregate", "measure": "l_extendedprice"} | plan
    return lambda spark, d: _rounded(compile_plan(table(spark, d), Plan(**plan)))


_COUNTS = "count(*) as row_count, cast(sum(case when l_discount = 0.0 then 1 else 0 end) as bigint) as trace_rows"
_NO_TRACE = "count(*) as row_count, cast(0 as bigint) as trace_rows"


def _sql(metric: str, where: str = "l_extendedprice is not null", groups: str = "", table: str = "lineitem", counts: str = _COUNTS, tail: str = "") -> str:
    names = ", ".join(g.split(" as ")[-1] for g in groups.split(", ")) if groups else ""
    return f"select {groups + ', ' if groups else ''}round(cast({metric} as double), 2) as metric_value, {counts} from {table} where {where}{' group by ' + ', '.join(str(i + 1) for i in range(len(names.split(', ')))) if names else ''} {tail}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


for _agg in ("sum", "avg", "max", "min"):
    _add(f"agg_{_agg}", _run(_li, aggregation=_agg), _sql(f"{_agg}(l_extendedprice)"))
_add("agg_count", _run(_li, aggregation="count"), _sql("count(l_extendedprice)", "true"))
_add("breakdown_one", _run(_li, intent="breakdown", groups=("l_returnflag",)), _sql("sum(l_extendedprice)", groups="l_returnflag"))
_add("breakdown_two", _run(_li, intent="breakdown", groups=("l_returnflag", "l_linestatus")), _sql("sum(l_extendedprice)", groups="l_returnflag, l_linestatus"))
for _name, _down in (("ranking_desc", True), ("ranking_asc", False)):
    _add(
        _name, _run(_li, intent="ranking", measure="l_quantity", groups=("l_suppkey",), descending=_down, limit=10),
        _sql("sum(l_quantity)", "l_quantity is not null", "l_suppkey", tail=f"order by sum(l_quantity) {'desc' if _down else 'asc'}, l_suppkey limit 10"),
    )
_add("trend_year", _run(_li, intent="trend", groups=("year",)), _sql("sum(l_extendedprice)", groups="cast(year(l_shipdate) as integer) as year"))
_add("trend_month", _run(_li, intent="trend", groups=("period_month",)), _sql("sum(l_extendedprice)", groups="cast(month(l_shipdate) as integer) as period_month"))
_add("filter_eq_ci", _run(_li, filters=(Filter("l_returnflag", "=", ("r",)),)), _sql("sum(l_extendedprice)", "lower(l_returnflag) = lower('r')"))
_add("filter_in", _run(_li, filters=(Filter("l_returnflag", "=", ("r", "A")),)), _sql("sum(l_extendedprice)", "lower(l_returnflag) in ('r', 'a')"))
for _name, _op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _add(f"filter_{_name}", _run(_li, filters=(Filter("l_quantity", _op, (25.0,)),)), _sql("sum(l_extendedprice)", f"l_quantity {_op} 25"))
_add("filter_month_int", _run(_li, time=TimeSpec(months=(6, 7, 8, 9))), _sql("sum(l_extendedprice)", "month(l_shipdate) in (6, 7, 8, 9)"))
_add(
    "filter_month_text", lambda s, d: _rounded(compile_plan(_li(s, d).drop("period_month").withColumn("month", F.date_format("l_shipdate", "MMM")), Plan("aggregate", "l_extendedprice", time=TimeSpec(months=(1, 2))))),
    _sql("sum(l_extendedprice)", "month(l_shipdate) in (1, 2)"),
)
_add(
    "trend_month_text", lambda s, d: _rounded(compile_plan(_li(s, d).withColumn("month", F.date_format("l_shipdate", "MMMM")), Plan("trend", "l_extendedprice", groups=("month",), limit=3))),
    _sql("sum(l_extendedprice)", groups="monthname(l_shipdate) as month", tail="having month(min(l_shipdate)) <= 3"),
)
_add("filter_season", _run(_li, time=TimeSpec(months=S.SEASONS["JJAS"])), _sql("sum(l_extendedprice)", "month(l_shipdate) between 6 and 9"))
_SEASON = "case when month(l_shipdate) <= 2 then 'JF' when month(l_shipdate) <= 5 then 'MAM' when month(l_shipdate) <= 9 then 'JJAS' else 'OND' end"
_add(
    "season_breakdown", lambda s, d: _rounded(compile_plan(_li(s, d).withColumn("season", S.season(F.col("period_month"))), Plan("breakdown", "l_extendedprice", groups=("season",)))),
    _sql("sum(l_extendedprice)", groups=f"{_SEASON} as season"),
)
_ORD = {"table": "orders", "counts": _NO_TRACE}
_add("filter_year_in", _run(_orders, measure="o_totalprice", time=TimeSpec(years=(1996, 1998)), date="o_orderdate"), _sql("sum(o_totalprice)", "year(o_orderdate) in (1996, 1998)", **_ORD))
_add("filter_year_between", _run(_orders, measure="o_totalprice", time=TimeSpec(year_from=1996, year_to=1998), date="o_orderdate"), _sql("sum(o_totalprice)", "year(o_orderdate) between 1996 and 1998", **_ORD))
_add("lookup", lambda s, d: compile_plan(_t(s, d, "region"), Plan("lookup", "r_regionkey", groups=("r_name",))).orderBy("r_name"), "select r_name, r_regionkey as metric_value from region")
_add(
    "count_nonnull_vs_rows", lambda s, d: compile_plan(_t(s, d, "lineitem").withColumn("discount", F.nullif(F.col("l_discount"), F.lit(0.0))), Plan("aggregate", "discount", "count")).select(F.col("metric_value").alias("n"), "row_count"),
    "select count(nullif(l_discount, 0)) as n, count(*) as row_count from lineitem",
)

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_add(
    "profile_measures",
    lambda s, d: profile.measures(_li(s, d), _MEASURES).select("measure", "n", "total_rows", "missing", *[F.round(c, 2).alias(c) for c in ("total", "mean", "lo", "hi")], "traces"),
    " union all ".join(
        f"select '{m}' as measure, count({m}) as n, count(*) as total_rows, count(*) - count({m}) as missing, round(sum({m}), 2) as total, round(avg({m}), 2) as mean, round(min({m}), 2) as lo, round(max({m}), 2) as hi, "
        "cast(sum(case when l_discount = 0.0 then 1 else 0 end) as bigint) as traces from lineitem" for m in _MEASURES
    ),
)
_add("median_exact", lambda s, d: profile.median(_t(s, d, "lineitem"), "l_extendedprice").select(F.round("median", 2).alias("median")), "select round(median(l_extendedprice), 2) as median from lineitem")
_add("distinct_count", lambda s, d: profile.cardinality(_t(s, d, "part"), ["p_brand"]).select(F.col("p_brand").alias("n")), "select count(distinct p_brand) as n from part")
_add("distinct_values", lambda s, d: profile.distinct_values(_t(s, d, "part"), "p_brand"), "select distinct p_brand as value from part where p_brand is not null order by 1 limit 2000")
_add("top_categories", lambda s, d: profile.top_values(_t(s, d, "orders"), "o_orderpriority"), "select o_orderpriority as value, count(*) as n from orders where o_orderpriority is not null group by 1 order by 2 desc, 1 limit 8")
_add(
    "kpi", lambda s, d: profile.measures(_t(s, d, "customer"), ["c_acctbal"]).select("n", *[F.round(c, 2).alias(c) for c in ("total", "mean", "lo", "hi")]),
    "select count(c_acctbal) as n, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 2) as mean, round(min(c_acctbal), 2) as lo, round(max(c_acctbal), 2) as hi from customer",
)
_SERIES = "select c_mktsegment, round(sum(c_acctbal), 2) as metric_value from customer group by 1 order by sum(c_acctbal) desc, 1 limit 24"


def _series(s: SparkSession, d: str) -> DataFrame:
    return _rounded(compile_plan(_t(s, d, "customer"), Plan("breakdown", "c_acctbal", groups=("c_mktsegment",), limit=24))).select("c_mktsegment", "metric_value")


_add("chart_series", _series, _SERIES)
_add("cv_spread", lambda s, d: profile.spread(_series(s, d), "metric_value").select(F.round("cv", 6).alias("cv")), f"select round(case when count(metric_value) < 2 or avg(metric_value) = 0 then 0.0 else stddev_pop(metric_value) / abs(avg(metric_value)) end, 6) as cv from ({_SERIES})")


def _checksum(s: SparkSession, d: str) -> DataFrame:
    li = _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("parsed_total"))
    o = _t(s, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("stated_total"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "stated_total", "parsed_total", profile.checksum(F.col("stated_total"), F.col("parsed_total")).alias("agrees"))


_add(
    "checksum", _checksum,
    "select o_orderkey, round(o_totalprice, 2) as stated_total, parsed_total, abs(parsed_total - round(o_totalprice, 2)) <= greatest(0.01, abs(round(o_totalprice, 2)) * 1e-6) as agrees from orders join "
    "(select l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as parsed_total from lineitem group by 1) on o_orderkey = l_orderkey",
)


def _wide(s: SparkSession, d: str) -> DataFrame:
    li = _li(s, d)
    cells = [F.round(F.sum(F.when(F.col("period_month") == k, F.col("l_quantity"))), 2).alias(m[:3].title()) for k, m in enumerate(S.MONTHS, 1)]
    return li.groupBy("year").agg(*cells, F.round(F.sum("l_quantity"), 2).alias("Annual"))


_MONTHS = [m[:3].title() for m in S.MONTHS]
_WIDE = "select cast(year(l_shipdate) as integer) as year, " + ", ".join(f"round(sum(case when month(l_shipdate) = {k} then l_quantity end), 2) as \"{m}\"" for k, m in enumerate(_MONTHS, 1)) + ", round(sum(l_quantity), 2) as \"Annual\" from lineitem group by 1"
_add(
    "melt_months", lambda s, d: reshape.melt(_wide(s, d), ["year"], _MONTHS),
    f"with w as ({_WIDE}) " + " union all ".join(f"select year, '{m}' as period, cast({k} as bigint) as period_month, \"{m}\" as value from w" for k, m in enumerate(_MONTHS, 1)),
)
_add(
    "derived_detect", lambda s, d: reshape.derived(_wide(s, d), "Annual", _MONTHS),
    f"with w as ({_WIDE}), c as (select abs({' + '.join(f'coalesce(\"{m}\", 0)' for m in _MONTHS)} - \"Annual\") <= abs(\"Annual\") * 0.02 as ok from w where \"Annual\" is not null) "
    "select count(*) as compared, avg(case when ok then 1.0 else 0.0 end) as agree_share, count(*) >= 3 and avg(case when ok then 1.0 else 0.0 end) >= 0.8 as is_derived from c",
)
_add("context_columns", lambda s, d: _t(s, d, "region").withColumns({"station": F.lit("PUNE"), "period": F.lit("1991-2020")}), "select *, 'PUNE' as station, '1991-2020' as period from region")


def _numbered(df: DataFrame, by: str, pieces: int = 64) -> DataFrame:
    """The rows with their number ``_no`` from 0 in the order of ``by``: counted in each of so many ranges of it, after what stands before the range."""
    cuts = df.agg(F.percentile_approx(by, [k / pieces for k in range(1, pieces)], 10_000)).first()[0] or []
    piece = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x <= F.col(by))) if cuts else F.lit(0)
    d, before, begins = df.withColumn("_piece", F.when(F.col(by).isNull(), F.lit(pieces)).otherwise(piece)), 0, []
    for r in d.groupBy("_piece").count().orderBy("_piece").collect():
        begins += [F.lit(r["_piece"]), F.lit(before)]
        before += r["count"]
    no = F.row_number().over(Window.partitionBy("_piece").orderBy(F.col(by).asc_nulls_last())) - 1
    return d.withColumn("_no", no + (F.create_map(*begins)[F.col("_piece")] if begins else F.lit(0))).drop("_piece")


def _sheet(df: DataFrame, by: str, top: int = 1) -> DataFrame:
    """The cells of a sheet that holds a table under a bold header, its rows in the order of ``by``."""
    texts = F.array(*[F.col(c).cast("string") for c in df.columns])
    rows = _numbered(df, by).select((F.col("_no") + top).cast("int").alias("row"), texts.alias("texts")).select("row", F.posexplode("texts").alias("col", "raw"))
    heads = df.sparkSession.range(1).select(F.lit(top - 1).alias("row"), F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("col", "raw"))
    every = rows.withColumn("bold", F.lit(False)).unionAll(heads.withColumn("bold", F.lit(True)))
    kind = F.when(F.col("raw").rlike(S.NUMBER), "NUM").otherwise("TEXT")
    return every.select(F.lit("sheet.xlsx").alias("path"), F.lit("Sheet").alias("sheet"), "row", "col", "raw", kind.alias("kind"), F.col("bold").alias("styled"), F.lit(False).alias("wide"))


def _ingested(cells: DataFrame) -> DataFrame:
    """The one table of a sheet without missing codes, found, described and typed."""
    (recipe,) = ingest.analyse(cells, ())
    return ingest.table(cells, recipe, "d", "2026-01-01")


_add(
    "ingest_typed", lambda s, d: _ingested(_sheet(_t(s, d, "supplier"), "s_suppkey")).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_acctbal", "_source_row"),
    "select s_suppkey, s_name, s_acctbal, cast(row_number() over (order by s_suppkey) + 1 as bigint) as _source_row from supplier",
)
_add(
    "ingest_melted", lambda s, d: _ingested(_sheet(_wide(s, d), "year")).select("year", "period", "period_month", "value", "_source_row"),
    f"with w as ({_WIDE}), n as (select *, row_number() over (order by year) + 1 as r from w) "
    + " union all ".join(f"select cast(year as bigint) as year, '{m}' as period, cast({k} as bigint) as period_month, \"{m}\" as value, cast(r as bigint) as _source_row from n" for k, m in enumerate(_MONTHS, 1)),
)


def _replayed(s: SparkSession, d: str) -> DataFrame:
    """A table read by the layout of another sheet, in which it stood eight rows higher."""
    t = _t(s, d, "supplier")
    return ingest.table(moved := _sheet(t, "s_suppkey", 9), ingest.replay(moved, ingest.analyse(_sheet(t, "s_suppkey"), ()))[0], "d", "2026-01-01")


_add(
    "ingest_replayed", lambda s, d: _replayed(s, d).select("s_suppkey", "s_name", "s_acctbal", "_source_row"),
    "select cast(s_suppkey as double) as s_suppkey, s_name, s_acctbal, cast(row_number() over (order by s_suppkey) + 9 as bigint) as _source_row from supplier",
)


def _with_total(s: SparkSession, d: str) -> DataFrame:
    r = _t(s, d, "region").select(F.col("r_name").alias("label"), F.col("r_regionkey").cast("long").alias("n"))
    return reshape.without_totals(r.unionAll(r.agg(F.lit("Grand total"), F.sum("n"))), "label")


_add("totals_excluded", _with_total, "select r_name as label, cast(r_regionkey as bigint) as n from region")
_CELL = "case l_linenumber when 1 then '(' || q || ')' when 2 then q || '%' when 3 then 'trace' when 4 then '-999' when 5 then '1,0' || q when 6 then 'calm' else ' ' end"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string")).select("l_orderkey", "l_linenumber", F.expr(_CELL).alias("cell"))


_add(
    "parse_number", lambda s, d: _cells(s, d).select("l_orderkey", "l_linenumber", S.parse_number(F.col("cell")).alias("p")).select("l_orderkey", "l_linenumber", F.round("p.value", 6).alias("value"), "p.text", "p.is_missing", "p.is_trace"),
    "with c as (select l_orderkey, l_linenumber, cast(l_quantity as integer) as q from lineitem) select l_orderkey, l_linenumber, "
    "case l_linenumber when 1 then -cast(q as double) when 2 then round(q / 100.0, 6) when 3 then 0.0 when 4 then null when 5 then cast('10' || q as double) end as value, "
    "case when l_linenumber = 6 then 'calm' end as text, l_linenumber = 4 or l_linenumber > 6 as is_missing, l_linenumber = 3 as is_trace from c",
)
_BRACKETED = (
    "case l_linenumber when 1 then '(' || q || '%)' when 2 then q || '(1)' when 3 then '1(' || q || ')' when 4 then '($' || q || ',000)' when 5 then ' ( ' || q || '.5 ) ' when 6 then q || ' %' else q || ')%' end"
)
_add(
    "parse_number_brackets",
    lambda s, d: _t(s, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string")).select("l_orderkey", "l_linenumber", S.parse_number(F.expr(_BRACKETED)).alias("p")).select("l_orderkey", "l_linenumber", F.round("p.value", 6).alias("value"), "p.text"),
    f"with c as (select l_orderkey, l_linenumber, cast(l_quantity as integer) as n, cast(cast(l_quantity as integer) as varchar) as q from lineitem), t as (select *, {_BRACKETED} as cell from c) select l_orderkey, l_linenumber, "
    "case l_linenumber when 1 then round(-n / 100.0, 6) when 4 then cast(-1000 * n as double) when 5 then cast(-n - 0.5 as double) when 6 then round(n / 100.0, 6) end as value, case when l_linenumber in (2, 3) or l_linenumber > 6 then cell end as text from t",
)
_add("missing_sentinels", lambda s, d: _cells(s, d).groupBy("l_linenumber").agg(F.count_if(S.parse_number(F.col("cell"))["is_missing"]).alias("n")), "select l_linenumber, cast(sum(case when l_linenumber = 4 or l_linenumber > 6 then 1 else 0 end) as bigint) as n from lineitem group by 1")
_add("trace_values", lambda s, d: _cells(s, d).groupBy("l_linenumber").agg(F.count_if(S.parse_number(F.col("cell"))["is_trace"]).alias("n")), "select l_linenumber, cast(sum(case when l_linenumber = 3 then 1 else 0 end) as bigint) as n from lineitem group by 1")


def _departures(s: SparkSession, d: str) -> DataFrame:
    m = _li(s, d).groupBy("year", "period_month").agg(F.sum("l_quantity").alias("value"))
    n = m.groupBy("period_month").agg(F.avg("value").alias("normal"))
    p = F.round(S.departure(F.col("value"), F.col("normal")), 4)
    return m.join(n, "period_month").select("year", "period_month", p.alias("percent"), S.departure_band(p).alias("band"))


_add(
    "departure_band", _departures,
    "with m as (select cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as period_month, sum(l_quantity) as value from lineitem group by 1, 2), n as (select period_month, avg(value) as normal from m group by 1), "
    "p as (select year, m.period_month, round((value - normal) * 100.0 / normal, 4) as percent from m join n on m.period_month = n.period_month) "
    "select *, case when percent >= 60 then 'Large Excess' when percent >= 20 then 'Excess' when percent >= -19 then 'Normal' when percent >= -59 then 'Deficient' when percent >= -99 then 'Large Deficient' when percent >= -100 then 'No Rain' end as band from p",
)
_add("station_alias", lambda s, d: _t(s, d, "nation").select("n_nationkey", S.alias(F.col("n_name"), {"nation_3": "pune", "nation_7": "mumbai"}).alias("station")), "select n_nationkey, case lower(n_name) when 'nation_3' then 'pune' when 'nation_7' then 'mumbai' else lower(n_name) end as station from nation")
_add("tokens", lambda s, d: _t(s, d, "documents").select("doc_id", F.size(S.tokens(F.col("text"))).cast("long").alias("n")), "select doc_id, cast(len(regexp_extract_all(lower(text), '[a-z0-9]+')) as bigint) as n from documents")
_TERMS = ["ther", "licens", "idiot"]
_add("bm25_search", lambda s, d: search.bm25(_t(s, d, "documents"), "doc_id", "text", _TERMS), (
    "with e as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as toks from documents), f as (select doc_id, cast(len(toks) as double) as len, "
    + ", ".join(f"cast(len(list_filter(toks, lambda x: starts_with(x, '{t}'))) as double) as f{i}" for i, t in enumerate(_TERMS))
    + " from e), s as (select cast(count(*) as double) as n, avg(len) as a, " + ", ".join(f"cast(count(*) filter (f{i} > 0) as double) as n{i}" for i in range(3)) + " from f) select doc_id, round("
    + " + ".join(f"(case when ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 then 1e-6 else ln((n - n{i} + 0.5) / (n{i} + 0.5)) end) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(3))
    + ", 6) as score from f, s where f0 + f1 + f2 > 0 order by score desc, doc_id limit 20"
))
_add("value_match", lambda s, d: search.value_match(_t(s, d, "nation"), "n_name", "sales of nation_3 and nation_12 please"), "select n_name as value from nation where n_name in ('NATION_3', 'NATION_12')")

_SOUGHT = "promo brushed steel of NATION_3 and nation_12, asia"


def _lexicon(s: SparkSession, d: str) -> DataFrame:
    own = (("part", ["p_type", "p_brand"]), ("nation", ["n_name"]), ("region", ["r_name"]))
    return functools.reduce(DataFrame.unionAll, [lexicon.of_values(_t(s, d, t), F.lit(t), slugs, F.lit("d")) for t, slugs in own])


def _lex_search(s: SparkSession, d: str) -> DataFrame:
    entries = _lexicon(s, d)
    return lexicon.search(lexicon.postings(entries), lexicon.statistics(entries), nlq.telling(_SOUGHT))


_LEX = "with e as (select *, regexp_extract_all(lower(target), '[a-z0-9]+') as toks from (" + " union ".join(f"select '{t}' as table_id, '{c}' as slug, trim({c}) as target from {t}" for t, c in (("part", "p_type"), ("part", "p_brand"), ("nation", "n_name"), ("region", "r_name"))) + "))"
_LEX_WORDS = sorted(nlq.telling(_SOUGHT))
_LEX_LIST = "[" + ", ".join(f"'{w}'" for w in _LEX_WORDS) + "]"
_add("lex_search", _lex_search, (
    f"{_LEX}, f as (select *, cast(len(toks) as double) as len, " + ", ".join(f"cast(len(list_filter(toks, lambda x: starts_with(x, '{w}'))) as double) as f{i}" for i, w in enumerate(_LEX_WORDS))
    + " from e), s as (select cast(count(*) as double) as n, avg(len) as a, " + ", ".join(f"cast(count(*) filter (f{i} > 0) as double) as n{i}" for i in range(len(_LEX_WORDS))) + " from f) select table_id, 'value' as kind, slug, target, round("
    + " + ".join(f"(case when ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 then 1e-6 else ln((n - n{i} + 0.5) / (n{i} + 0.5)) end) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / a))" for i in range(len(_LEX_WORDS)))
    + f" + case when list_has_all({_LEX_LIST}, toks) then 4.0 when list_has_any({_LEX_LIST}, toks) then 1.0 else 0.0 end, 6) as score from f, s where " + " + ".join(f"f{i}" for i in range(len(_LEX_WORDS))) + " > 0 order by score desc, table_id, slug, target limit 24"
))
_add("lex_value_match", lambda s, d: lexicon.named(lexicon.postings(_lexicon(s, d)), nlq.spellings(_SOUGHT)), f"{_LEX} select table_id, slug, target from e where len(toks) > 0 and list_has_all([{', '.join(repr(w) for w in nlq.spellings(_SOUGHT))}], toks)")
_add(
    "station_name", lambda s, d: _t(s, d, "nation").select("n_nationkey", S.station_name(F.concat("n_name", F.lit(" (A)  AMS (mo) mormugao")), {"nation_3 mormugao": "goa"}).alias("station")),
    "select n_nationkey, case lower(n_name) when 'nation_3' then 'goa' else lower(n_name) || ' mormugao' end as station from nation",
)
_add("ist_from_utc", lambda s, d: _t(s, d, "orders").select("o_orderkey", F.date_format(S.ist_from_utc(F.col("o_orderdate").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm").alias("ist")), "select o_orderkey, strftime(cast(o_orderdate as timestamp) + interval '5 hours 30 minutes', '%Y-%m-%d %H:%M') as ist from orders")
_add("row_hash", lambda s, d: _t(s, d, "nation").select("n_nationkey", S.row_hash(F.col("n_nationkey"), F.col("n_name")).alias("row_hash")), "select n_nationkey, substr(sha1(cast(n_nationkey as varchar) || chr(31) || n_name), 1, 16) as row_hash from nation")
_add("preview", lambda s, d: _t(s, d, "customer").orderBy("c_custkey").limit(50).select("c_custkey", "c_name", "c_mktsegment"), "select c_custkey, c_name, c_mktsegment from customer order by c_custkey limit 50")
_add("catalog_join", lambda s, d: _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.max("n_name").alias("last")), 'select r_name, count(*) as n, max(n_name) as "last" from nation join region on n_regionkey = r_regionkey group by 1')
_add("first_seen_dedupe", lambda s, d: reshape.first_seen(_t(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"]), "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as k from events) where k = 1")


def _ask(question: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return _rounded(nlq.Asker({"sales": (_li(s, d), nlq.SALES), "orders": (_orders(s, d), nlq.ORDERS)}).rows(question))

    return run


_add("ask_top_suppliers", _ask("top 5 supplier by extended price"), _sql("sum(l_extendedprice)", groups="l_suppkey", tail="order by sum(l_extendedprice) desc, l_suppkey limit 5"))
_add("ask_total", _ask("total extended price in july?"), _sql("sum(l_extendedprice)", "l_extendedprice is not null and month(l_shipdate) = 7"))
_add("ask_monsoon_average", _ask("average quantity during monsoon by return flag"), _sql("avg(l_quantity)", "month(l_shipdate) between 6 and 9", "l_returnflag"))
_add("ask_trend", _ask("total price of orders by year"), _sql("sum(o_totalprice)", "o_totalprice is not null", "cast(year(o_orderdate) as integer) as year", **_ORD))
_add("ask_filter", _ask("number of orders above 100000 between 1996 and 1998"), _sql("count(o_totalprice)", "o_totalprice > 100000 and year(o_orderdate) between 1996 and 1998", **_ORD))
_SPOKEN = {
    "ne_monsoon": ("total extended price in the ne monsoon from 1995 through 1997", "month(l_shipdate) between 10 and 12 and year(l_shipdate) between 1995 and 1997"),
    "premonsoon": ("total extended price in premonsoon, 1996 until 1998", "month(l_shipdate) between 3 and 5 and year(l_shipdate) between 1996 and 1998"),
    "rainy_season": ("total extended price in the rainy season 1994-1996", "month(l_shipdate) between 6 and 9 and year(l_shipdate) between 1994 and 1996"),
    "cold_weather": ("total extended price in cold weather of 1995", "month(l_shipdate) <= 2 and year(l_shipdate) = 1995"),
}
for _name, (_question, _where) in _SPOKEN.items():
    _add(f"ask_{_name}", _ask(_question), _sql("sum(l_extendedprice)", f"l_extendedprice is not null and {_where}"))


def _flag_normals(s: SparkSession, d: str) -> DataFrame:
    """Mean over the years of each return flag's quantity in each month."""
    per = _li(s, d).groupBy("l_returnflag", "period_month", "year").agg(F.sum("l_quantity").alias("q"))
    return per.groupBy("l_returnflag", "period_month").agg(F.avg("q").alias("quantity"))


def _ask_departure(s: SparkSession, d: str) -> DataFrame:
    normals = (nlq.Column("quantity", "measure", ("quantity",)), nlq.Column("l_returnflag", "dimension", ("return", "flag")), nlq.Column("period_month", "time", ("month",)))
    asker = nlq.Asker({"sales": (_li(s, d), nlq.SALES), "normals": (lambda: _flag_normals(s, d), normals)}, normals=("normals",))
    return _rounded(asker.rows("departure of total quantity in july 1996 by return flag from normal")).select("l_returnflag", "metric_value", F.round("normal", 2).alias("normal"), "departure_pct", "band")


_add(
    "ask_departure", _ask_departure,
    "with m as (select l_returnflag, year(l_shipdate) as y, sum(l_quantity) as q from lineitem where month(l_shipdate) = 7 group by 1, 2), n as (select l_returnflag, avg(q) as normal from m group by 1), "
    "p as (select l_returnflag, q, normal, (q - normal) * 100.0 / normal as percent from m join n using (l_returnflag) where y = 1996) select l_returnflag, round(q, 2) as metric_value, round(normal, 2) as normal, round(percent, 1) as departure_pct, "
    "case when percent >= 60 then 'Large Excess' when percent >= 20 then 'Excess' when percent >= -19 then 'Normal' when percent >= -59 then 'Deficient' when percent >= -99 then 'Large Deficient' when percent >= -100 then 'No Rain' end as band from p",
)

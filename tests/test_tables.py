"""Every table query against its SQL, and the pieces behind them."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur import nlq
from larkspur.errors import AmbiguousQuery, QueryFailed, Unanswerable
from larkspur.functions import scalars as S
from larkspur.plans.plan import Filter, Plan, TimeSpec, compile_plan, spans

SF = "/root/testdata/sf0.001"
NAMES = [k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(rows):
    value = lambda v: "null" if v is None or v != v else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_sql_gives_the_same(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert plain(got.select(*sorted(cols)).collect()) == plain(tuple(r[i] for i in order) for r in want.fetchall())


def test_numbers_in_text(spark):
    cells = ["T", "-999", "1,20,000", "(45.5)", "(-5)", "99.9%", "nan", "1_000", "1d", None, "999.9", "₹ 12", "(5%)", "45(1)", "1(2)", "(₹ 1,200)", "5%%"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(S.parse_number(S.F.col("c")).alias("p"))
    got = [r.p for r in df.collect()]
    assert [g.value for g in got] == [0.0, None, 120000.0, -45.5, 5.0, pytest.approx(0.999), None, None, None, None, None, 12.0, -0.05, None, None, -1200.0, 0.05]
    assert [g.is_missing for g in got] == [False, True, False, False, False, False, True, False, False, True, True, False, *[False] * 5]
    assert got[0].is_trace and [got[k].text for k in (7, 13, 14)] == ["1_000", "45(1)", "1(2)"]


def test_times():
    assert nlq.parse_time("monsoon rainfall")[0].months == (6, 7, 8, 9)
    assert nlq.parse_time("post monsoon cyclones")[0].months == (10, 11, 12)
    assert nlq.parse_time("in may at pune")[1] == "in at pune"
    assert nlq.parse_time("total in july?")[0].months == (7,)
    t, rest = nlq.parse_time("rain between 1998 and 1996")
    assert (t.year_from, t.year_to, rest) == (1996, 1998, "rain")
    with pytest.raises(Unanswerable):
        nlq.parse_time("rain in the last 3 months")
    t, rest = nlq.parse_time("rain in the last 3 years", dt.date(2026, 5, 1))
    assert (t.year_from, t.year_to, rest) == (2024, 2026, "rain in the")
    for said in ("1995 through 2000", "1995 until 2000", "1995-2000", "1995 – 2000", "from 1995 to 2000", "1995 and 2000"):
        t, rest = nlq.parse_time(f"rain {said} at pune")
        assert (t.years, t.year_from, t.year_to, rest) == ((), 1995, 2000, "rain at pune")
    assert nlq.parse_time("rain 1995, 2000")[0].years == (1995, 2000)
    seasons = {
        (1, 2): ("jf", "winter", "cold weather"), (3, 4, 5): ("mam", "pre-monsoon", "pre monsoon", "premonsoon", "hot weather", "summer"), (6, 7, 8, 9): ("jjas", "monsoon", "southwest monsoon", "sw monsoon", "rainy season"),
        (10, 11, 12): ("ond", "post-monsoon", "post monsoon", "postmonsoon", "northeast monsoon", "ne monsoon", "retreating monsoon"),
    }
    for months, names in seasons.items():
        for n in names:
            assert (nlq.parse_time(f"rain in the {n} at pune")[0].months, nlq.parse_time(f"rain in the {n} at pune")[1]) == (months, "rain in the at pune")


def test_refusals(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, 2, "a"), (3.0, 3, None)], "m double, n int, g string")
    with pytest.raises(Unanswerable):
        compile_plan(df, Plan("aggregate", "m", time=TimeSpec(months=(1,))))
    with pytest.raises(QueryFailed):
        compile_plan(df, Plan("aggregate", "m", filters=(Filter("nowhere", "=", ("x",)),)))
    got = compile_plan(df, Plan("ranking", "m", groups=("g",), limit=5)).collect()
    assert [(r.g, r.metric_value, r.row_count) for r in got] == [(None, 3.0, 1), ("a", 1.0, 1)]
    cols = (nlq.Column("m", "measure", ("rain",)), nlq.Column("n", "measure", ("rain",)))
    with pytest.raises(AmbiguousQuery):
        nlq.Asker({"t": (df, cols)}).resolve("total rain")
    with pytest.raises(Unanswerable):
        nlq.Asker({"t": (df, cols)}).resolve("wind speed at 850 hPa")


def test_names_meant_but_not_spelt(spark):
    df = spark.createDataFrame([("Mumbai", 1.0, 2.0)], "city string, max_temp_c double, rainfall_mm double")
    cols = (
        nlq.Column("city", "dimension", ("city",)), nlq.Column("max_temp_c", "measure", ("max", "temp"), "degC", nlq.synonyms("max_temp_c"), "Max Temp (C)"),
        nlq.Column("rainfall_mm", "measure", ("rainfall",), "mm", nlq.synonyms("rainfall_mm"), "Rainfall (mm)"),
    )
    asker = nlq.Asker({"t": (df, cols)}, {"t": {"city": ("Mumbai", "Pune", "Pushkar")}})

    def plan(question):
        return asker.resolve(question)[1]

    # a synonym, told where it shares no stem
    assert plan("total precipitation").measure == "rainfall_mm" and plan("total precipitation").notes == ("Nothing is known of 'precipitation'; the answer is about Rainfall (mm).",)
    assert plan("total rain").notes == ()
    # a misspelt measure, a longer word, a guess that is told
    assert plan("total rainfal").notes == ("No measure is spelt 'rainfal'; Rainfall (mm) comes nearest.",)
    assert plan("what is the sea surface temperature").notes == ("No measure is spelt 'temperature'; Max Temp (C) comes nearest.",)
    assert plan("what is the sea surface temperature").aggregation == "avg"
    # former and misspelt values
    assert plan("rainfall at Bombay").filters[0].values == ("Mumbai",) and plan("rainfall at Bombay").notes == ()
    assert plan("rainfall at Mumbay").filters[0].values == ("Mumbai",) and plan("rainfall at Mumbay").notes == ("No value is spelt 'mumbay'; Mumbai comes nearest.",)
    assert plan("rainfall at Delhi").filters == () and plan("rainfall at Delhi").notes == ("Nothing is known of 'rainfall delhi'; the answer is about Rainfall (mm).",)
    with pytest.raises(Unanswerable):
        plan("wind speed")


def test_median_of_odd_columns(spark):
    from larkspur.operators import profile

    inf = float("inf")
    cases = [[], [None, float("nan")], [3.0], [1.0, 2.0], [5.0] * 99, [0.0] * 50 + [1.0] * 50, [1e300, -1e300, *range(200)], [inf, -inf, 1.0, 2.0, *[3.0] * 7], [*range(1000), 1e18], [inf] * 60 + [1.0] * 59]
    for values in cases:
        real = sorted(v for v in values if v is not None and v == v)
        want = (real[(len(real) - 1) // 2] + real[len(real) // 2]) / 2 if real else None
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
        assert profile.median(df, "v", buckets=8, most=10).first()[0] == want


def test_medians_of_many_columns_take_as_many_jobs_as_of_one(spark):
    from larkspur.operators import profile

    inf = float("inf")
    cases = [[], [None, float("nan")], [3.0], [1.0, 2.0], [5.0] * 99, [0.0] * 50 + [1.0] * 50, [1e300, -1e300, *range(200)], [inf, -inf, 1.0, 2.0, *[3.0] * 7], [*range(1000), 1e18], [inf] * 60 + [1.0] * 59]
    n = max(map(len, cases))
    rows = [tuple(float(c[i]) if i < len(c) and c[i] is not None else None for c in cases) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(len(cases))))
    got = profile.medians(df, df.columns, buckets=8, most=10)
    for k, values in enumerate(cases):
        real = sorted(v for v in values if v is not None and v == v)
        assert got[f"c{k}"] == ((real[(len(real) - 1) // 2] + real[len(real) // 2]) / 2 if real else None)
    assert profile.medians(df, []) == {} and profile.medians(df.where("false"), ["c1"]) == {"c1": None}


def test_tops_and_sketches(spark):
    from larkspur.operators import profile

    df = spark.createDataFrame([(i % 3, f"v{i % 40}", "x" if i % 2 else None) for i in range(200)], "g int, a string, b string")
    got = profile.tops(df, ["a", "b"], 2).collect()
    assert [tuple(r) for r in got] == [("a", None, 40, None), ("a", "v0", 5, 1), ("a", "v1", 5, 2), ("b", None, 1, None), ("b", "x", 100, 1)]
    assert profile.tops(df.where("false"), ["a"]).collect() == []
    s = profile.sketches(df, ["g"], ["a", "b"])
    merged = {r.slug: r.n for r in s.where("slug <> ''").groupBy("slug").agg(S.F.hll_sketch_estimate(S.F.hll_union_agg("sketch")).alias("n")).collect()}
    assert merged == {"a": 40, "b": 1} and s.where("slug = ''").agg(S.F.sum("rows")).first()[0] == 200


def test_years_and_spellings_reach_the_scan(spark, scanned):
    for name in ("filter_year_in", "filter_year_between", "ask_filter"):
        told = scanned(entry.queries()[name](spark, SF))
        assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in told and "LessThan(o_orderdate,1999-01-01" in told, (name, told)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    two = compile_plan(orders, Plan("aggregate", "o_totalprice", filters=(Filter("o_orderpriority", "=", ("1-urgent",), ("1-URGENT", "1-Urgent")),)))
    assert "In(o_orderpriority" in scanned(two) and two.first().row_count == orders.where("lower(o_orderpriority) = '1-urgent'").count()


def test_spans_of_dates():
    day = dt.date
    assert spans(TimeSpec(months=(7,))) == [] == spans(TimeSpec())
    assert spans(TimeSpec(years=(1996, 1998))) == [(day(1996, 1, 1), day(1997, 1, 1)), (day(1998, 1, 1), day(1999, 1, 1))]
    assert spans(TimeSpec(year_from=1996, year_to=1997)) == [(day(1996, 1, 1), day(1998, 1, 1))]
    assert spans(TimeSpec(year_from=1996)) == [(day(1996, 1, 1), None)] and spans(TimeSpec(year_to=1996)) == [(None, day(1997, 1, 1))]
    assert spans(TimeSpec(months=(12, 1), years=(1996, 1997))) == [(day(1996, 1, 1), day(1996, 2, 1)), (day(1996, 12, 1), day(1997, 2, 1)), (day(1997, 12, 1), day(1998, 1, 1))]
    assert spans(TimeSpec(months=(5, 7), year_from=1801, year_to=2100)) == [(day(1801, 5, 1), day(2100, 8, 1))]


def test_departures_from_normals(spark):
    rain = spark.createDataFrame([("a", 2001, 7, 10.0), ("a", 2002, 7, 30.0), ("b", 2001, 7, 50.0), (None, 2001, 7, 5.0), ("a", 2001, 8, 99.0)], "station string, year int, period_month int, rain double")
    usual = spark.createDataFrame([("a", 7, 10.0), ("b", 7, 100.0), ("c", 7, 1.0), ("a", 8, 1.0)], "station string, period_month int, normal_rain double")
    cols = (nlq.Column("rain", "measure", ("rain",), "mm"), nlq.Column("station", "dimension", ("station",)), nlq.Column("year", "time", ("year",)), nlq.Column("period_month", "time", ("month",)))
    own = (nlq.Column("normal_rain", "measure", ("rain",), "mm"), nlq.Column("station", "dimension", ("station",)), nlq.Column("period_month", "time", ("month",)))
    asker = nlq.Asker({"t": (rain, cols), "n": (usual, own)}, normals=("n",))
    got = {r.station: (r.metric_value, r.normal, r.departure_pct, r.band) for r in asker.rows("departure of total rain in july by station").collect()}
    # of two years, the mean is compared
    assert got == {"a": (40.0, 10.0, 100.0, "Large Excess"), "b": (50.0, 100.0, -50.0, "Deficient"), None: (5.0, None, None, None)}
    one = asker.rows("total rain in july 2001, departure from normal").first()
    assert (one.metric_value, one.normal) == (65.0, 111.0)
    with pytest.raises(Unanswerable):
        nlq.Asker({"t": (rain, cols)}).resolve("departure of rain by station")


def test_months_in_text_take_one_pattern(spark):
    said = ["Jan", "january", " JANUA. ", "ja", "januaryx", "May", "Sept", "xmay", "", None, "2-Dec", "decem ber"]
    df = spark.createDataFrame([(x,) for x in said], "c string")
    want = [1, 1, 1, None, None, 5, 9, None, None, None, 12, 12]
    assert [r[0] for r in df.select(S.month_number(S.F.col("c"))).collect()] == want
    assert [r[0] for r in df.select(S.in_months(S.F.col("c"), (1, 9)))
            .collect()] == [None if x is None else k in (1, 9) for x, k in zip(said, want)]
    plan = compile_plan(df.selectExpr("c as month", "1 as v"), Plan("aggregate", "v", time=TimeSpec(months=(1, 2))))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1

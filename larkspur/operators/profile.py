"""Statistics of a table, each from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def measures(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per measure (and key ``by``): n, total_rows, missing, total, mean, lo, hi, traces; one aggregate for all."""
    by = by or []
    trace = F.count_if("is_trace") if "is_trace" in df.columns else F.lit(0).cast("long")
    one = df.groupBy(*by).agg(
        F.count("*").alias("rows"), trace.alias("traces"),
        *[F.struct(F.count(c).alias("n"), F.sum(c).cast("double").alias("total"), F.avg(c).cast("double").alias("mean"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"m_{c}") for c in names],
    )
    rows = [F.struct(F.lit(c).alias("measure"), F.col(f"m_{c}").alias("s")) for c in names]
    out = one.select(*by, "rows", "traces", F.inline(F.array(*rows)))
    return out.select(*by, "measure", "s.n", F.col("rows").alias("total_rows"), (F.col("rows") - F.col("s.n")).alias("missing"), "s.total", "s.mean", "s.lo", "s.hi", "traces")


#: Rows that are sorted for a median, at most.
SORTED = 50_000


def median(df: DataFrame, name: str, buckets: int = 4096, most: int = SORTED) -> DataFrame:
    """Exact median by narrowing: histograms find a range of at most ``most`` rows that holds the middle, only these are sorted.

    A histogram has at most ``buckets`` rows whatever the table's size, and each
    looks at the range that the one before found, so outliers cost a round, not
    a large sort.  Infinite values are values; NaN and null are none.
    """
    v = df.select(F.col(name).cast("double").alias("v")).where("v is not null and not isnan(v)")
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n, below = span["lo"], span["hi"], span["n"], 0
    first, second = (n - 1) // 2, n // 2
    answer = lambda x: v.sparkSession.range(1).select(F.lit(x).cast("double").alias("median"))
    largest = 1.7976931348623157e308
    finite = lambda x: min(max(x, -largest), largest) / 2  # noqa: E731  halves: their differences are finite
    while n > most and lo < hi:
        here = F.greatest(F.least(F.col("v"), F.lit(largest)), F.lit(-largest)) / 2
        place = F.least(F.floor((here - finite(lo)) / (finite(hi) - finite(lo)) * buckets), F.lit(buckets - 1))
        rows = v.where(F.col("v").between(lo, hi)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for k, r in enumerate(rows):
            if below + r["n"] > first:
                break
            below += r["n"]
        if below + r["n"] <= second:  # the two in the middle are neighbours in two buckets
            return answer((r["hi"] + rows[k + 1]["lo"]) / 2)
        lo, hi, n = r["lo"], r["hi"], r["n"]
    if lo is None or lo == hi:
        return answer(lo)
    return v.where(F.col("v").between(lo, hi)).orderBy("v").offset(first - below).limit(second - first + 1).agg(F.avg("v").alias("median"))


def cardinality(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: the number of distinct values of each column."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in names])


def top_values(df: DataFrame, name: str, k: int = 8) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def distinct_values(df: DataFrame, name: str, k: int = 2000) -> DataFrame:
    return df.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct().orderBy("value").limit(k)


def spread(df: DataFrame, name: str) -> DataFrame:
    """Coefficient of variation: population deviation over |mean|; 0 for fewer than two values or mean 0."""
    cv = F.when((F.count(name) < 2) | (F.avg(name) == 0), F.lit(0.0)).otherwise(F.stddev_pop(name) / F.abs(F.avg(name)))
    return df.agg(cv.alias("cv"))


def checksum(stated, parsed):
    """Whether a parsed total agrees with the stated one."""
    return F.abs(parsed - stated) <= F.greatest(F.lit(0.01), F.abs(stated) * 1e-6)


def tops(df: DataFrame, names: list[str], k: int = 8) -> DataFrame:
    """slug, value, n, no: the ``k`` commonest values of each column by rank ``no`` and, where ``no`` is null, how many it has; one job.

    Values of all columns are stacked and counted in one shuffle, which both parts read.
    """
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("slug"), F.col(c).cast("string").alias("value")) for c in names]))).where("value is not null")
    n = each.groupBy("slug", "value").agg(F.count("*").alias("n"))
    best = n.select("*", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("n"), "value")).alias("no")).where(F.col("no") <= k)
    return best.unionAll(n.groupBy("slug").agg(F.lit(None).cast("string").alias("value"), F.count("*").alias("n"), F.lit(None).cast("int").alias("no"))).orderBy("slug", "no")


def medians(df: DataFrame, names: list[str], buckets: int = 4096, most: int = SORTED) -> dict[str, float | None]:
    """Exact medians of columns, narrowed together: as ``median``, with one job a round whatever the number of columns."""
    if not names:
        return {}
    largest = 1.7976931348623157e308
    value = lambda c: F.col(c).cast("double")
    v = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("m"), value(c).alias("v")) for i, c in enumerate(names)]))).where("v is not null and not isnan(v)")
    out: dict[int, float | None] = dict.fromkeys(range(len(names)))
    #: lowest and highest value of the range that holds the middle, its rows, rows below it, places of the two in the middle
    open_ = {r["m"]: [r["lo"], r["hi"], r["n"], 0, (r["n"] - 1) // 2, r["n"] // 2] for r in v.groupBy("m").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}

    def within(of: dict[int, list]) -> DataFrame:
        ends = v.sparkSession.createDataFrame([(m, x[0], x[1]) for m, x in of.items()], "m int, lo double, hi double")
        return v.join(F.broadcast(ends), "m").where(F.col("v").between(F.col("lo"), F.col("hi")))  # a row a column

    half = lambda c: F.greatest(F.least(c, F.lit(largest)), F.lit(-largest)) / 2  # noqa: E731  halves: their differences are finite
    while large := {m: x for m, x in open_.items() if x[2] > most and x[0] < x[1]}:
        place = F.least(F.floor((half(F.col("v")) - half(F.col("lo"))) / (half(F.col("hi")) - half(F.col("lo"))) * buckets), F.lit(buckets - 1))
        hist: dict[int, list] = {}
        for r in within(large).groupBy("m", place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("m", "b").collect():
            hist.setdefault(r["m"], []).append(r)
        for m, rows in hist.items():
            below, first, second = open_[m][3:]
            for k, r in enumerate(rows):
                if below + r["n"] > first:
                    break
                below += r["n"]
            if below + r["n"] <= second:  # the two in the middle are neighbours in two buckets
                out[m] = (r["high"] + rows[k + 1]["low"]) / 2
                del open_[m]
            else:
                open_[m] = [r["low"], r["high"], r["n"], below, first, second]
    out |= {m: x[0] for m, x in open_.items() if x[0] == x[1]}
    rest = {m: x for m, x in open_.items() if x[0] < x[1]}
    if rest:
        spots = v.sparkSession.createDataFrame([(m, x[4] - x[3] + 1, x[5] - x[3] + 1) for m, x in rest.items()], "m int, a int, b int")
        sorted_ = within(rest).groupBy("m").agg(F.sort_array(F.collect_list("v")).alias("vs")).join(F.broadcast(spots), "m")  # ``most`` values each
        out |= {r["m"]: r["x"] for r in sorted_.select("m", ((F.element_at("vs", F.col("a")) + F.element_at("vs", F.col("b"))) / 2).alias("x")).collect()}
    return {c: out[i] for i, c in enumerate(names)}


def sketches(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, slug, rows, sketch: a mergeable sketch of each column's distinct values for each key; the row with slug '' has the count alone."""
    per = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.hll_sketch_agg(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(f"s{k}") for k, c in enumerate(names)])
    each = [F.struct(F.lit("").alias("slug"), F.lit(None).cast("binary").alias("sketch")), *[F.struct(F.lit(c).alias("slug"), F.col(f"s{k}").alias("sketch")) for k, c in enumerate(names)]]
    return per.select(*keys, "rows", F.inline(F.array(*each)))

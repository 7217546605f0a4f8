"""Mixing sources to target weights by hash thresholds.

Every row has a 64-bit hash.  A first pass sums the words of each source by the
top bits of the hash; the running sum tells in which bucket a source's budget
ends.  Only that bucket is split by the next bits, again and again, until it
holds one row.  The mix is then a filter: hash below the source's threshold.
Nothing is sorted but histograms, whose size does not depend on the data.

Defined cases: a null source is a source, listed last; a null text has no
words; rows that are equal in id and text share a hash and are taken together;
a source without words gets the target 0; a long text is counted whole; other
columns are ignored; an empty table gives an empty result.

Limits, a row a source, are counted and broadcast if there are at most ``FEW``;
otherwise rows are salted before they meet them, so a source that has a third of
all rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_SET, durable, free_name, settle

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BITS = 12
LEVELS = 5
#: Sources whose limits are broadcast, at most; and parts that a source's rows are dealt over where there are more.
FEW, SALTS = 10_000, 64


def _size(text: Column) -> Column:
    """Words in a text: starts of words, counted without making them."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, f"[{BLANK_SET}]"), "")).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: sources filled by weight up to ``most`` times their size.

    Sharing out the excess again and again ends where target = least(weight *
    level, limit) for one level; sources reach their limits in the order of
    limit / weight, so that level is found from running sums over the sources.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.lit([float(w) for w in weights]), F.pmod(no, F.lit(len(weights))))
    s = s.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("most"))
    every = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    done = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("at", F.col("most") / F.col("weight"))
    s = s.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("most").over(done), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(done), F.lit(0.0))).alias("open"),
    )
    # the level if this source and all after it stay below their limits
    s = s.withColumn("level", F.when((F.col("total") - F.col("full")) / F.col("open") <= F.col("at"), (F.col("total") - F.col("full")) / F.col("open")))
    # the first in that order counts; with the limits reached exactly all are full
    s = s.withColumn("no", F.row_number().over(Window.orderBy("at", F.col("source").asc_nulls_last())))
    level = F.min(F.when(F.col("level").isNotNull(), F.struct("no", "level"))).over(every)["level"]
    return s.select("source", "source_size", F.coalesce(F.least(F.col("weight") * level, F.col("most")), F.col("most")).alias("target"))


def _with_limits(rows: DataFrame, source: str, limits: DataFrame, few: bool) -> DataFrame:
    """Rows (with ``key``) beside the limits of their source, which are named ``of``."""
    if few:
        return rows.join(F.broadcast(limits), F.col(source).eqNullSafe(F.col("of")))
    salted = rows.withColumn("part_", F.pmod("key", F.lit(SALTS)).cast("int"))
    each = limits.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, F.col(source).eqNullSafe(F.col("of")) & (F.col("part_") == F.col("of_part"))).drop("part_", "of_part")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, copies, below: rows get ``copies``, one more if key < below.

    ``key`` is the row's hash as an unsigned number, in ``sized``.
    """
    goals = goals.select("*", F.least(F.floor(F.try_divide("target", "source_size")), F.lit(MOST)).cast("int").alias("copies"))
    goals = goals.select("source", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies"))
    goals = goals.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    # lo: hashes below are taken, worth ``got``; the boundary lies in [lo, lo + 2**width)
    state = durable(goals.select("*", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("got"), F.lit(False).alias("closed")))
    few = state.count() <= FEW
    for level in range(LEVELS):
        width = 60 - BITS * (level + 1)
        now = state.withColumnRenamed("source", "of")
        inside = _with_limits(sized.select("source", "size", "key"), "source", now.where("not closed and rest > 0"), few).where(
            (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("lo") + F.lit(1 << (width + BITS)))
        )
        hist = inside.groupBy("of", F.shiftright("key", width).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        w = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.select("*", F.sum("words").over(w).alias("upto"))
        step = hist.join(state, F.col("of").eqNullSafe(F.col("source"))).where(
            (F.col("got") + F.col("upto") - F.col("words") < F.col("rest")) & (F.col("got") + F.col("upto") >= F.col("rest"))
        )
        # of the bucket in which the budget ends: all of a last row is taken if that comes nearer
        last = (F.col("n") == 1) | F.lit(level == LEVELS - 1)
        take = last & (F.col("got") + F.col("upto") - F.col("rest") <= F.col("rest") - F.col("got") - F.col("upto") + F.col("words"))
        step = step.groupBy("of").agg(F.min_by(F.struct(
            (F.shiftleft("bucket", width) + F.when(take, F.lit(1 << width)).otherwise(F.lit(0))).alias("lo"),
            (F.col("got") + F.col("upto") - F.when(take, F.lit(0)).otherwise(F.col("words"))).alias("got"),
            last.alias("closed"),
        ), "bucket").alias("x"))
        new = state.join(step, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "copies", "rest",
            F.coalesce("x.lo", "lo").alias("lo"), F.coalesce("x.got", "got").alias("got"), F.coalesce("x.closed", F.lit(True)).alias("closed"),
        )
        state = durable(new)
        if state.where("not closed").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", F.col("lo").alias("below"))


def assign(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep``, size, source_size, target and times, how often the mix takes each row."""
    keep = keep or ["doc_id"]
    spec = [F.col(f"`{c}`") for c in keep]
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 4)
    sized = durable(settle(docs, "doc_id", "source", _size(F.col("text")).alias("size"), key.alias("key")))
    limits = thresholds(sized, targets(sized))
    times = (F.col("copies") + F.when(F.col("key") < F.col("below"), F.lit(1)).otherwise(F.lit(0))).alias("times")
    lim, few = limits.withColumnRenamed("source", "of"), limits.count() <= FEW
    if keep == ["doc_id"]:
        return _with_limits(sized, "source", lim, few).select("doc_id", "size", "source_size", "target", times)
    d = docs.select(*spec, F.col("source").alias("from"), key.alias("key"), _size(F.col("text")).alias("size"))
    return _with_limits(d, "from", lim, few).select(*spec, "size", "source_size", "target", times)


def query(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, columns as they were."""
    row = free_name(docs, "whole_row")
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    d = assign(packed, [row]).where("times > 0")
    d = d.select(row, F.explode(F.sequence(F.lit(1), F.col("times"))))
    return d.select(*[F.col(row)[c].alias(c) for c in docs.columns])

"""BM25 over a term table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokens

K1, B = 1.2, 0.75


def bm25_weight(terms: int) -> Column:
    """An entry's weight from its ``len``, its counts ``f<i>`` of terms, and the collection's ``n``, ``avg`` and ``n<i>``."""
    total = F.lit(0.0)
    for i in range(terms):
        idf = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col(f"f{i}")
        total += F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return total


def bm25(entries: DataFrame, key: str, text: str, terms: list[str], k: int = 20) -> DataFrame:
    """key, score: the best ``k`` entries; a term matches tokens that begin with it.

    One scan counts tokens and matches per entry, one small aggregate has the
    collection's numbers; no token is shuffled.
    """
    begins = lambda t: F.filter("toks", lambda x: F.startswith(x, F.lit(t)))
    # a generator of one row keeps the tokens from being made again for each term
    made = F.struct(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    e = entries.select(F.inline(F.array(made)))
    e = e.select("key", F.size("toks").cast("double").alias("len"), *[F.size(begins(t)).cast("double").alias(f"f{i}") for i, t in enumerate(terms)])
    s = e.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(terms))])
    hit = sum((F.col(f"f{i}") for i in range(len(terms))), F.lit(0.0)) > 0
    out = e.where(hit).crossJoin(F.broadcast(s))  # one row of numbers
    return out.select(F.col("key").alias(key), F.round(bm25_weight(len(terms)), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def value_match(values: DataFrame, column: str, question: str, k: int = 24) -> DataFrame:
    """Distinct values all of whose tokens stand in the question."""
    q = F.array(*[F.lit(t) for t in sorted(set(re.findall("[a-z0-9]+", question.lower())))])
    v = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    t = tokens(F.col("value"))
    return v.where((F.size(t) > 0) & (F.size(F.array_except(t, q)) == 0)).orderBy("value").limit(k)

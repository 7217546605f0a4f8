"""What a question can name, as postings.

An entry is a column or one distinct value of a dimension; a value has no limit
on how many others its column holds.  A posting is one distinct word of an entry
with all that an answer needs of the entry, so a look-up reads no other table.
Postings are written in the order of their words: Parquet's statistics leave
only those parts to be read that can hold the words asked for.  How many entries
there are, and how many words they have, is kept for each dataset and summed, so
no search counts them anew.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalars import tokens
from .operators.search import bm25_weight

ENTRY = "table_id string, kind string, slug string, target string, words string, dataset_id string"
POSTING = "term string, place int, n long, len long, kinds int, entry_id string, table_id string, kind string, slug string, target string, dataset_id string"
STATISTICS = "dataset_id string, entries long, words long"
#: Added to the score when all words of a target stand in the question, or some.
ALL_WORDS, SOME_WORDS = 4.0, 1.0


def of_columns(spark: SparkSession, columns: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Entries of columns: (table_id, slug, target, all words that mean it, dataset)."""
    df = spark.createDataFrame(columns, "table_id string, slug string, target string, words string, dataset_id string")
    return df.select("table_id", F.lit("column").alias("kind"), "slug", "target", "words", "dataset_id")


def of_values(df: DataFrame, table: Column, slugs: list[str], dataset: Column) -> DataFrame:
    """Entries of all distinct values of some columns, in one pass and one shuffle; null and blank values are none."""
    pairs = F.array(*[F.struct(F.lit(s).alias("slug"), F.trim(F.col(s).cast("string")).alias("target")) for s in slugs])
    v = df.select(table.alias("table_id"), dataset.alias("dataset_id"), F.inline(pairs)).where("target <> ''").distinct()
    return v.select("table_id", F.lit("value").alias("kind"), "slug", "target", F.col("target").alias("words"), "dataset_id")


def postings(entries: DataFrame) -> DataFrame:
    """A row for each distinct word of an entry: its count ``n`` and ``place`` there, and the entry's words in all and distinct ones; no shuffle."""
    said = F.concat_ws("\x1f", "table_id", "kind", "slug", "target")
    own = [F.sha1(said).alias("entry_id"), *[F.col(c) for c in ("table_id", "kind", "slug", "target", "dataset_id")]]
    made = entries.select(F.inline(F.array(F.struct(*own, tokens(F.col("words")).alias("toks"))))).withColumn("each", F.array_distinct("toks"))
    each = F.transform("each", lambda t, i: F.struct(t.alias("term"), i.alias("place"), F.size(F.filter("toks", lambda x: x == t)).cast("long").alias("n")))
    out = made.select(*[c for c in made.columns if c not in ("toks", "each")], F.size("toks").cast("long").alias("len"), F.size("each").alias("kinds"), F.inline(each))
    return out.select(*[c.split()[0] for c in POSTING.split(", ")])


def in_order(postings: DataFrame) -> DataFrame:
    """As they are to be written: ranges of words, in order in each file."""
    return postings.repartitionByRange("term").sortWithinPartitions("term")


def statistics(entries: DataFrame) -> DataFrame:
    """A row of ``STATISTICS`` for each dataset; blank entries have no word but count as entries."""
    return entries.groupBy("dataset_id").agg(F.count("*").alias("entries"), F.sum(F.size(tokens(F.col("words"))).cast("long")).alias("words"))


def search(postings: DataFrame, stats: DataFrame, words: list[str], k: int = 24, kind: str | None = None) -> DataFrame:
    """table_id, kind, slug, target, score: the best ``k`` entries by BM25 and the boosts.

    A word matches terms that begin with it; only those are read and shuffled.
    ``kind`` filters after the match, so it doesn't change a score.  No words: no
    rows.
    """
    words = sorted(set(words))
    begins = [F.col("term").startswith(w) for w in words]
    hit = functools.reduce(operator.or_, begins, F.lit(False))
    facts = F.struct("len", "table_id", "kind", "slug", "target")
    f = postings.where(hit).groupBy("entry_id").agg(F.first(facts).alias("e"), *[F.sum(F.when(b, F.col("n")).otherwise(0)).cast("double").alias(f"f{i}") for i, b in enumerate(begins)])
    f = f.select("e.*", *[f"f{i}" for i in range(len(words))]).withColumn("len", F.col("len").cast("double"))
    n = stats.agg(F.sum("entries").cast("double").alias("n"), F.sum("words").cast("double").alias("of"))
    df = f.agg(F.count("*").alias("hits"), *[F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(words))])
    all_ = n.crossJoin(F.broadcast(df)).withColumn("avg", F.col("of") / F.col("n"))  # one row each
    t, asked = F.array_distinct(tokens(F.col("target"))), F.array(*[F.lit(w) for w in words]).cast("array<string>")
    boost = F.when((F.size(t) > 0) & (F.size(F.array_except(t, asked)) == 0), ALL_WORDS).when(F.arrays_overlap(t, asked), SOME_WORDS).otherwise(0.0)
    out = f.crossJoin(F.broadcast(all_)).select("table_id", "kind", "slug", "target", F.round(bm25_weight(len(words)) + boost, 6).alias("score"))
    if kind:
        out = out.where(F.col("kind") == kind)
    return out.orderBy(F.desc("score"), "table_id", "kind", "slug", "target").limit(k)


def named(postings: DataFrame, words: list[str]) -> DataFrame:
    """table_id, slug, target: the values all of whose words stand among ``words``; only postings of these words are read."""
    hit = postings.where((F.col("kind") == "value") & (F.col("term").isin(*sorted(set(words))) if words else F.lit(False)))
    return hit.groupBy("entry_id", "table_id", "slug", "target", "kinds").agg(F.count("*").alias("found")).where("found = kinds").select("table_id", "slug", "target")


def _ratio(words: pd.Series, targets: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, w, t).ratio() for w, t in zip(words, targets)], dtype=float)


def near(postings: DataFrame, words: list[str], alike: float, letters: int, k: int = 3) -> DataFrame:
    """word, table_id, slug, target, ratio: for each word the ``k`` values nearest in spelling, of those that begin with the same letters.

    A value's first word begins with these letters too, so only that part of the
    postings is read, however many values there are.  The edit distance of two
    spellings is at most (1 - ratio) times their letters, which leaves few for
    the exact ratio; nothing but ``k`` values a word reaches the driver.
    """
    words = sorted({w for w in words if len(w) >= letters})
    if not words:
        return postings.select(F.lit("").alias("word"), "table_id", "slug", "target", F.lit(0.0).alias("ratio")).where("false")
    head = functools.reduce(operator.or_, [F.col("term").startswith(h) for h in sorted({w[:letters] for w in words})])
    v = postings.where((F.col("kind") == "value") & (F.col("place") == 0) & head).select("table_id", "slug", "target", F.lower("target").alias("t"))
    v = v.select("*", F.explode(F.array(*[F.lit(w) for w in words])).alias("word")).where(F.col("t").startswith(F.substring("word", 1, letters)))
    far = F.ceil((F.char_length("word") + F.char_length("t")) * (1 - alike)).cast("int")
    v = v.where(F.levenshtein("word", "t") <= far).withColumn("ratio", F.pandas_udf(_ratio, "double")("word", "t")).where(F.col("ratio") >= alike)
    w = Window.partitionBy("word").orderBy(F.desc("ratio"), "slug", "target", "table_id")
    return v.select("word", "table_id", "slug", "target", "ratio", F.row_number().over(w).alias("no")).where(F.col("no") <= k).drop("no")


def rows_by_word(rows: Iterator) -> dict[str, list]:
    """The rows of ``near`` by word, the nearest first."""
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["word"], -r["ratio"], r["slug"], r["target"])):
        out.setdefault(r["word"], []).append(r)
    return out

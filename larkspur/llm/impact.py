"""Ranked lexical search over a bit-sliced impact index.

What a term adds to a document's score is a whole number, its impact.  The
index holds blocks of at most ``BLOCK`` documents; in a block each term has one
bitmap over the documents for each bit of its impacts.  A query's scores of all
documents of a block come from adding its terms' bitmaps as columns of bits,
with carries: a few operations on whole bitmaps for each bit, none for each
document.  The best ``k`` are found from the most significant slice down, and a
task hands on only its best ``k`` for each query.

Documents never move: blocks are made where the rows are read.  Counts are
stored first, since impacts need how many documents there are, how long they
are and how many hold a term; then bitmaps are made and searched in one pass.
Queries come in groups of about ``HELD`` bytes, which every worker holds; each
further group is one more pass, whatever the number of queries.  An index made
for one group can be written and searched again (``index``, ``search``).

Defined cases: null and empty texts have no term, and count neither among the
documents nor in their length; a long text is read in pieces of about
``PIECE`` bytes; rows with equal ids are documents of their own and take a rank
each; null ids come last among equal scores; rows of queries with equal ids are
one query with all their terms; a query without terms, or without a document
above 0, has no rows; other columns are ignored; an empty table of documents or
queries gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored

#: Documents of a block.
BLOCK = 1024
#: Bytes of query text that are held together.
HELD = 8 << 20
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Over UTF-8 in which A-Z are lower case: digits, letters, and all that is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_OUTSIDE = re.compile(rb"[^0-9a-z\x80-\xff]")
COUNTS = "n array<long>, term array<int>, at array<int>, tf array<long>"


def terms_of(text: bytes) -> Counter:
    """How often each term stands in a text."""
    text, at, out = text.lower(), 0, Counter()  # of bytes, lower() changes A-Z alone
    while at < len(text):
        end = len(text)
        if at + PIECE < end:
            gap = _OUTSIDE.search(text, at + PIECE)
            end = gap.start() if gap else end
        out.update(TERM.findall(text, at, end))
        at = end
    return out


def _counted(known: dict[bytes, int], id_type: pa.DataType):
    """Blocks of documents in the order of their ids: lengths, and a posting for each known term of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                ids = b.column(0).slice(k, BLOCK).to_pylist()
                texts = b.column(1).slice(k, BLOCK).cast(pa.large_binary())
                order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
                n, term, at, tf = [], [], [], []
                for spot, i in enumerate(order):
                    found = terms_of(texts[i].as_py() or b"")
                    n.append(found.total())
                    for t in found.keys() & known.keys():
                        term.append(known[t])
                        at.append(spot)
                        tf.append(found[t])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([[ids[i] for i in order]], pa.list_(id_type)), pa.array([n], pa.list_(pa.int64())), *[pa.array([x], pa.list_(t)) for x, t in ((term, pa.int32()), (at, pa.int32()), (tf, pa.int64()))]],
                    names=["ids", "n", "term", "at", "tf"],
                )

    return run


def counts(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """A row for each block of documents, with the postings of the known terms, numbered as given."""
    kind = docs.schema["doc_id"].dataType
    return stored(docs.select("doc_id", "text").mapInArrow(_counted(known, to_arrow_type(kind)), f"ids array<{kind.simpleString()}>, {COUNTS}"))


def statistics(counted: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms with repeats, and documents of each known term."""
    lengths = F.filter("n", lambda x: x > 0)
    total = counted.agg(F.sum(F.size(lengths)), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    df = counted.select(F.explode("term").alias("term")).groupBy("term").count().collect()  # a row for each known term
    return total[0] or 0, total[1] or 0, {r[0]: r[1] for r in df}


def slices(term: np.ndarray, at: np.ndarray, impact: np.ndarray, docs: int):
    """Each term, the first byte of its bitmaps that is in use, and its bitmaps from there, lowest bit first."""
    names, row = np.unique(term, return_inverse=True)
    if not len(names):
        return [], [], []
    start = np.full(len(names), docs)
    np.minimum.at(start, row, at)
    start //= 8
    out: list[list[bytes]] = [[] for _ in names]
    for j in range(int(impact.max()).bit_length()):
        has = (impact >> j) & 1 == 1
        bits = np.zeros((len(names), docs), bool)
        bits[row[has], at[has]] = True
        for own, s, x in zip(out, start.tolist(), np.packbits(bits, axis=1, bitorder="little")):
            own.append(x[s:].tobytes().rstrip(b"\0"))
    return names.tolist(), start.tolist(), out


def _indexed(many: int, length: int, df: dict[int, int], id_type: pa.DataType):
    weight = np.zeros(max(df, default=0) + 1, np.int64)
    for t, n in df.items():
        weight[t] = math.floor(1000 * math.log((2 * many + 2) / (2 * n + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, n, term, at, tf = (c[k].values for c in b.columns)
                m = np.array([100 - 90 + 90 * x * many // length if x else 10 for x in n.to_pylist()], np.int64)
                term, at, tf = (x.to_numpy() for x in (term, at, tf))
                impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
                some = impact > 0
                names, starts, maps = slices(term[some], at[some], impact[some], len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(id_type)), pa.array([names], pa.list_(pa.int32())), pa.array([starts], pa.list_(pa.int32())), pa.array([maps], pa.list_(pa.list_(pa.binary())))],
                    names=["ids", "term", "start", "slices"],
                )

    return run


def index(counted: DataFrame, many: int, length: int, df: dict[int, int]) -> DataFrame:
    """A row for each block: ids in order, and for each term its bitmaps."""
    kind = counted.schema["ids"].dataType
    return counted.select("ids", "n", "term", "at", "tf").mapInArrow(_indexed(many, length, df, to_arrow_type(kind.elementType)), f"ids {kind.simpleString()}, term array<int>, start array<int>, slices array<array<binary>>")


def added(a: list[int], b: list[int]) -> list[int]:
    """Sums, as bitmaps by bit, of the numbers that two lists of bitmaps hold."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], 0
    for x, y in zip(a, b):
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (carry & half)
    for x in a[len(b) :]:
        out.append(x ^ carry)
        carry &= x
    return [*out, carry] if carry else out


def top(total: list[int], k: int) -> list[tuple[int, int]]:
    """(number, place) of the ``k`` highest numbers above 0; of equal ones, those of the lowest places."""
    sure, open_ = 0, 0
    for x in total:
        open_ |= x
    for x in reversed(total):
        both = sure | (open_ & x)
        if (n := both.bit_count()) > k:
            open_ &= x
            continue
        sure, open_ = both, open_ ^ (open_ & x)
        if n == k:
            open_ = 0
            break
    spots, rest = [], k - sure.bit_count()
    while sure:
        low = sure & -sure
        spots.append(low.bit_length() - 1)
        sure ^= low
    while open_ and rest:
        low = open_ & -open_
        spots.append(low.bit_length() - 1)
        open_ ^= low
        rest -= 1
    return [(sum((x >> p & 1) << j for j, x in enumerate(total)), p) for p in spots]


def _searched(queries: list[tuple[object, list[int]]], k: int, item_type: pa.DataType, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        for b in batches:
            for r in range(b.num_rows):
                ids, names, starts, maps = (c[r].as_py() for c in b.columns)
                held = {t: [int.from_bytes(x, "little") << 8 * s for x in xs] for t, s, xs in zip(names, starts, maps)}
                for q, (_, terms) in enumerate(queries):
                    total: list[int] = []
                    for t in terms:
                        if t in held:
                            total = added(total, held[t])
                    if total:
                        more = [(-score, ids[p] is None, ids[p]) for score, p in top(total, k)]
                        best[q] = sorted([*best[q], *more])[:k]
        rows = [(q, s, d) for (q, _), own in zip(queries, best) for s, _, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], item_type), pa.array([r[2] for r in rows], id_type), pa.array([-r[1] for r in rows], pa.int64())], names=["item_id", "doc_id", "score"])

    return run


def search(indexed: DataFrame, queries: list[tuple[object, list[int]]], item_type, k: int = 10) -> DataFrame:
    """item_id, doc_id, score: the best ``k`` of each task for each query, given as its id and its terms' numbers."""
    kind = indexed.schema["ids"].dataType.elementType
    run = _searched(queries, k, to_arrow_type(item_type), to_arrow_type(kind))
    return indexed.select("ids", "term", "start", "slices").mapInArrow(run, f"item_id {item_type.simpleString()}, doc_id {kind.simpleString()}, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest score for each item."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)).alias("term")).distinct()
    size = asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    groups = math.ceil(size / HELD) or 1
    item_type, found = items.schema["item_id"].dataType, None
    for g in range(groups):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        known: dict[bytes, int] = {}
        queries = [(r["item_id"], [known.setdefault(t.encode(), len(known)) for t in r["terms"]]) for r in own]
        counted = counts(docs, known)
        part = search(index(counted, *statistics(counted)), queries, item_type, k)
        found = part if found is None else found.unionAll(part)
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank(docs, items)


ORACLE = r"""
with t as (
  select item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents where text is not null),
s as (select count(*) as n_docs, cast(sum(len(ws)) as bigint) as total from w where len(ws) > 0),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ws) as term from w) group by doc_id, term),
f as (select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from p, s group by term, n_docs),
m as (select doc_id, 100 - 90 + (90 * len(ws) * n_docs) // total as m from w, s where len(ws) > 0),
r as (
  select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from t join p using (term) join f using (term) join m using (doc_id) group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 10
"""

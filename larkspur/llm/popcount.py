"""Near-duplicate documents by 64-bit SimHash, joined over segment popcounts.

A fingerprint's bits are the majority of its shingles' XXH64 bits.  Cut into 32
segments of two bits, it is a point: the number of bits set in each segment.
The Manhattan distance of two points is never above the Hamming distance of
their fingerprints, so links are found by a range-join of points on a grid.
Links of ``radius`` bits need ``radius // 2 + 1`` grids, each over its own share
of the segments: of two points within ``radius``, some share is within 1.  A
point lies in its own cell of each grid (it is at home there) and visits the
cells one step up; so two points within 1 in a share meet at the home of one of
them.  Pairs that meet are compared by Manhattan distance first and then by
all bits.  The search is exact.

Points are distinct fingerprints, so any number of copies is one.  A cell gives
links that join what it holds, never all its pairs; one of more than ``BLOCK``
points is cut into blocks, and each two blocks are a group of their own, so a
task's size does not depend on any cell's.

Defined cases: null and empty texts, and texts without words, have fingerprint
zero and link like any other; a text of fewer than ``words`` words is one
shingle; a long text is read in pieces of about ``PIECE`` bytes; equal rows
repeat, and rows with equal ids are documents of their own; a row with a null
id links others, but never names a component: one of null ids alone has a null
``component_id``; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .minhash import components

WORDS, SEED, RADIUS = 3, 42, 3
SEGMENTS = 32
#: The lower bit of each segment.
LOW = 0x5555555555555555
#: Points of a block.
BLOCK = 4096
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A text's fingerprint: bits that over half of its shingles' hashes have set."""
    text, at, kept, votes, n = text.lower(), 0, [], np.zeros(64, np.int64), 0  # of bytes, lower() changes A-Z alone
    while at < len(text) or (kept and not n):
        end = len(text)
        if at + PIECE < end:
            gap = _BLANK.search(text, at + PIECE)
            end = gap.start() if gap else end
        own = kept + text[at:end].split()  # at ASCII white space
        last, at = at >= len(text), end
        if len(own) < words and not last:
            kept = own
            continue
        line = b" ".join(own)
        ends = np.cumsum([len(w) + 1 for w in own])
        starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()[words - 1 :] or [len(line)]
        h = np.array([xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, stops)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
        kept = own[len(own) - words + 1 :]
    return sum(1 << k for k in np.flatnonzero(2 * votes > n).tolist())


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed number, for each row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def point(fp: Column) -> Column:
    """The bits set in each segment, two bits a segment."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(F.lit(LOW))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def points(fp: np.ndarray) -> np.ndarray:
    """As ``point``, for numbers without sign."""
    high, low = fp >> np.uint64(1) & np.uint64(LOW), fp & np.uint64(LOW)
    return (high & low) << np.uint64(1) | (high ^ low)


def manhattan(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """Distance of points.  Counts of 0 and 2 alone differ in just the upper bit."""
    x = a ^ b
    odd = x & np.uint64(LOW)
    return np.bitwise_count(odd) + 2 * np.bitwise_count(x >> np.uint64(1) & np.uint64(LOW) & ~odd)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(fps: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """part, cell, fp of the points at home, and of the visitors."""
    grids = radius // 2 + 1
    home, away = [], []
    for g in range(grids):
        own = range(g * SEGMENTS // grids, (g + 1) * SEGMENTS // grids)
        cell = F.col("point").bitwiseAND(F.lit(_signed(sum(3 << 2 * k for k in own))))
        home.append(F.struct(F.lit(g).alias("part"), cell.alias("cell")))
        for k in own if radius else ():
            count = F.shiftrightunsigned("point", 2 * k).bitwiseAND(F.lit(3))
            up = cell.bitwiseXOR(F.when(count == 0, F.lit(_signed(1 << 2 * k))).otherwise(F.lit(_signed(3 << 2 * k))))  # 0 to 1, 1 to 2
            away.append(F.when(count < 2, F.struct(F.lit(g).alias("part"), up.alias("cell"))))
    d = fps.select("fp", point(F.col("fp")).alias("point"))
    none = d.where("false").select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("cell"), "fp")
    visits = d.select("fp", F.inline(F.array_compact(F.array(*away)))).select("part", "cell", "fp") if away else none
    return d.select("fp", F.inline(F.array(*home))).select("part", "cell", "fp"), visits


def forest(fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join what lies within ``radius``, from one of the points at home, over any of the cell."""
    order = np.argsort(~home, kind="stable")
    left, at_home = fp[order], home[order]
    place = points(left)
    us: list[int] = []
    vs: list[int] = []
    while len(left) > 1 and at_home[0]:
        todo = [left[0]]
        root = int(left[0])
        left, place, at_home = left[1:], place[1:], at_home[1:]
        while todo and len(left):
            f = todo.pop()
            near = manhattan(place, points(f)) <= radius
            near[near] = np.bitwise_count(left[near] ^ f) <= radius
            if near.any():
                found = left[near]
                todo.extend(found)
                us.extend(found.tolist())
                vs.extend([root] * len(found))
                left, place, at_home = left[~near], place[~near], at_home[~near]
    return us, vs


def _joined(radius: int):
    """Rows part, cell, i, j, fp, home in this order, of whole cells: their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(key: list[np.ndarray], fp: np.ndarray, home: np.ndarray, whole: bool):
            """Of all cells but the last, unless ``whole``; and what is left."""
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            bounds = [0, *new.tolist(), *([len(fp)] if whole else [])]
            us, vs = [], []
            for a, b in zip(bounds, bounds[1:]):
                u, v = forest(fp[a:b], home[a:b], radius)
                us += u
                vs += v
            k = bounds[-1]
            out = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)]
            return pa.RecordBatch.from_arrays(out, names=["u", "v"]), [*(c[k:] for c in key), fp[k:], home[k:]]

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols[4] = cols[4].view(np.uint64)
            held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols)]
            if len(held[4]):
                out, held = links(held[:4], held[4], held[5].astype(bool), False)
                yield out
        if held is not None and len(held[4]):
            yield links(held[:4], held[4], held[5].astype(bool), True)[0]

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links of at most ``radius`` bits between distinct fingerprints ``fp``; their components are those of all such links."""
    if not 0 <= radius < SEGMENTS:
        raise ValueError(f"radius must be at least 0 and less than {SEGMENTS}")
    home, visits = _cells(fps, radius)
    size = stored(home.groupBy("part", "cell").agg(F.count("*").alias("n")))
    seen = visits.join(size.select("part", "cell"), ["part", "cell"], "left_semi").withColumn("home", F.lit(False))
    seen = stored(seen)
    met = size.where("n > 1").select("part", "cell").unionAll(seen.select("part", "cell")).distinct()
    rows = seen.unionAll(home.join(met, ["part", "cell"], "left_semi").withColumn("home", F.lit(True)))
    rows = stored(rows)
    blocks = rows.groupBy("part", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    large = stored(blocks.where("blocks > 1"))
    one = F.lit(0)
    small = rows.join(large, ["part", "cell"], "left_anti").select("part", "cell", one.alias("i"), one.alias("j"), "fp", "home")
    cut = rows.join(large, ["part", "cell"]).withColumn("no", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cut = cut.select("part", "cell", "fp", "home", "no", F.explode(F.sequence(one, F.col("blocks") - 1)).alias("other"))
    cut = cut.select("part", "cell", F.least("no", "other").alias("i"), F.greatest("no", "other").alias("j"), "fp", "home")
    key = ["part", "cell", "i", "j"]
    dealt = small.unionAll(cut).repartition(*key).sortWithinPartitions(*key)
    return stored(dealt.mapInArrow(_joined(radius), "u long, v long").distinct())


def cluster(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    own = stored(fingerprints(docs, words))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    stars = components(links(nodes.select("fp"), radius))
    rooted = stored(nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    whole = stored(rooted.join(lowest, "root").select("fp", "component_id"))
    return own.join(whole, "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    c = cluster(docs)
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: those of the least id of each component, once; null ids stay."""
    c = cluster(docs, words, radius).where("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(c, "doc_id", "left_anti").select(*docs.columns)
    return out.where("doc_id is null").unionAll(out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))

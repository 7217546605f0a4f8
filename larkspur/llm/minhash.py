"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``side`` short keys (``rows`` minhashes each) are computed;
the table keys are all pairs of a key of the first and one of the second.  So
``side ** 2`` tables need the minhashes of only ``2 * side`` keys.  A pair with
similarity s meets in a table with probability (1 - (1 - s**rows)**side)**2:
0.99998 at s = 0.85 and 0.9996 at s = 0.8 with the defaults.  That is the only
loss: every later step is exact, and every link is confirmed on the full sets.

Equal sets are one node from the start.  Within a table's bucket each node is
first compared with the bucket's least node, which joins a group of g near
copies by about g comparisons.  Where a bucket still holds several components,
nodes that share a key are compared across components, block against block, so
a task's size depends on ``BLOCK`` alone; a sketch of one pass over a set tells
most pairs apart, and never a linked one.

Defined cases: null and empty texts, and texts without words, have the empty
set and link with nothing; a text of fewer than ``words`` words is one shingle;
rows with equal ids are one document of the link graph, but for rows without
words, which are alone whatever their id; a row with a null id takes part in no
group and is kept; a long text's set is the one of all its words; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .textops import mix, rows_of_words

SIDE = 12
ROWS = 3
#: Bits of a node's sketch.  A bit tells whether an odd number of its set's shingles
#: fell on it, so two sketches differ in at most as many bits as the sets differ in shingles.
SKETCH = 2048
#: Nodes of a block when nodes are compared all with all across components.
BLOCK = 512
#: Pairs that are confirmed together after the first comparison.
TOGETHER = 64
#: Links to a partition while components are found.
LINKS = 200_000
#: Bits of a sieve for each thing it lets through, and bits at most.
SIEVE, SIEVE_BITS = 16, 1 << 26


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int):
    """Yields (first row, counts, shingles): each row's sorted distinct shingle hashes, one after another."""
    weight = _odd(words, 7)
    for first, counts, h in rows_of_words(texts):
        ends = np.repeat(np.cumsum(counts), counts)
        n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
        starts = np.cumsum(counts) - counts
        at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = np.zeros(len(at), np.uint64)
        for k in range(words):
            spot = np.minimum(at + k, max(len(h) - 1, 0))
            s += np.where(at + k < ends[at], h[spot] * weight[k], np.uint64(k + 1)) if len(h) else np.uint64(0)
        s = mix(s)
        out, sizes, done = [], np.zeros(len(n), np.int64), 0
        for i, k in enumerate(n.tolist()):
            u = np.unique(s[done : done + k])
            out.append(u)
            sizes[i], done = len(u), done + k
        yield first, sizes, np.concatenate(out) if out else s


def _nodes(u: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each set, from sums over its shingles; equal sets have equal ones, and none is 0."""
    return np.maximum(mix(np.add.reduceat(u, at) ^ mix(np.add.reduceat(mix(u), at) + sizes.astype(np.uint64))), np.uint64(1))


def _signatures(words: int):
    multiply, add = _odd(2 * SIDE * ROWS, 3), _odd(2 * SIDE * ROWS, 5)
    fold = _odd(ROWS, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for first, sizes, u in shingle_sets(b.column(1), words):
                n = len(sizes)
                full = np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[full]
                keys = np.zeros((n, 2 * SIDE), np.uint64)
                node = np.zeros(n, np.uint64)
                if len(full):
                    node[full] = _nodes(u, at, sizes[full])
                    for k in range(2 * SIDE):
                        key = np.full(len(full), k + 1, np.uint64)
                        for r in range(ROWS):
                            j = k * ROWS + r
                            key += np.minimum.reduceat(u * multiply[j] + add[j], at) * fold[r]
                        keys[full, k] = mix(key)
                flat = pa.array(keys.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(sizes), pa.array(node.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, n * 2 * SIDE + 1, 2 * SIDE, dtype=np.int32), flat)],
                    names=["doc_id", "n_shingles", "node", "keys"],
                )

    return run


def sketches(u: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of ``SKETCH`` bits, packed, for each set."""
    out, ends = [], np.cumsum(sizes)
    for k in range(0, len(sizes), 1000):
        part = sizes[k : k + 1000]
        own = u[ends[k] - sizes[k] : ends[min(k + 1000, len(sizes)) - 1]]
        spot = np.repeat(np.arange(len(part)), part) * SKETCH + (own >> np.uint64(40)).astype(np.int64) % SKETCH
        out.append(np.packbits((np.bincount(spot, minlength=len(part) * SKETCH) & 1).astype(np.uint8).reshape(-1, SKETCH), axis=1))
    return np.concatenate(out)


def _sieve(values: DataFrame, n: int) -> np.ndarray:
    """Bits, a power of two of them, in which those of all ``n`` longs of ``values`` are set; Spark sets them, in groups of 64."""
    bits = 1 << min(max(6, (SIEVE * n - 1).bit_length()), SIEVE_BITS.bit_length() - 1)
    spot = values.select(F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("spot"))
    got = spot.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("of")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("at").to_numpy()] = got.column("of").to_numpy().view(np.uint64)
    return out


def _passes(sieve: np.ndarray, values: np.ndarray) -> np.ndarray:
    spot = values & np.uint64(len(sieve) * 64 - 1)
    return (sieve[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sets(words: int, ids: np.ndarray, both: np.ndarray):
    """Partition function: the sets of texts whose hashed id, and id with node, pass the sieves; all that are wanted do, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            some = np.flatnonzero(_passes(ids, own))
            texts, own = b.column(1).take(pa.array(some)), own[some]
            for first, sizes, u in shingle_sets(texts, words):
                h, ends = own[first : first + len(sizes)], np.cumsum(sizes)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                node = _nodes(u, (ends - sizes)[full], sizes[full])
                keep = _passes(both, h[full] ^ node)
                node, full = node[keep], full[keep]
                if not len(full):
                    continue
                sets = [u[i:j] for i, j in zip((ends - sizes)[full].tolist(), ends[full].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(sizes[full]), pa.array([x.tobytes() for x in sketches(np.concatenate(sets), sizes[full])], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["node", "size", "sketch", "set"],
                )

    return run


def _wanted_sets(d: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, size, sketch, set: one row for each node of ``wanted`` (node, doc_id), and a few others.

    Whole texts are shuffled nowhere: each task sifts those it reads.
    """
    n, own = wanted.count(), F.xxhash64("doc_id")
    ids, both = _sieve(wanted.select(own.alias("x")), n), _sieve(wanted.select(own.bitwiseXOR(F.col("node")).alias("x")), n)
    sets = stored(d.where("doc_id is not null").select(own.alias("own"), "text").mapInArrow(tidy(_sets(words, ids, both)), "node long, size long, sketch binary, set binary"))
    twice = stored(sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
    if twice.isEmpty():
        return sets
    # repeated rows, or copies that passed the sieves
    return stored(sets.join(twice, "node", "left_anti").unionAll(sets.join(twice, "node", "left_semi").dropDuplicates(["node"])))


def _confirm(num: int, den: int):
    """Cogroup function: the pairs (x, y) that are links, given the sets of their nodes, each once."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        own = {n: np.frombuffer(s.as_buffer(), np.uint64) for n, s in zip(sets.column("node").to_pylist(), sets.column("set"))}
        keep = np.zeros(pairs.num_rows, bool)
        for i, (x, y) in enumerate(zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist())):
            a, b = own[x], own[y]
            if den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                both = np.sort(np.concatenate([a, b]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = den * same >= num * (len(a) + len(b) - same)
        return pairs.select(["x", "y"]).filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, i: Column, j: Column, num: int, den: int) -> DataFrame:
    """u, v: the links among ``pairs``, confirmed in cells (i, j); a set goes once to each cell that has a pair of it."""
    p = pairs.select("x", "y", i.alias("i"), j.alias("j"))
    need = p.select(F.col("i").alias("k"), F.col("j").alias("l"), F.explode(F.array("x", "y")).alias("node")).distinct().join(sets.select("node", "set"), "node")
    good = p.groupBy("i", "j").cogroup(need.groupBy("k", "l")).applyInArrow(_confirm(num, den), "x long, y long")
    return stored(good.select(F.col("x").alias("u"), F.col("y").alias("v")))


def _near_pairs(num: int, den: int, every: bool):
    """Cogroup function: pairs of nodes of two blocks, or of one (``right`` is empty), that lie in different components and may be links, by size and sketch.

    All such pairs, each at the least key that both nodes have, or of each node that with the least partner.
    """

    def lists(keys: pa.ChunkedArray, gap: int) -> np.ndarray:
        """A node's keys in a row of ``SIDE``, the rest of which has ``gap``."""
        keys = keys.combine_chunks()
        n = np.diff(keys.offsets.to_numpy())
        out = np.full((len(n), SIDE), gap)
        out[np.arange(SIDE) < n[:, None]] = keys.flatten().to_numpy()
        return out

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        side, right = [], right if right.num_rows else left
        for t in (left, right):
            sketch, *rest = t.columns[-5:-1]
            side.append((np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(-1, SKETCH // 64), *(c.to_numpy() for c in rest)))
        (bits, size, root, node), (bits2, size2, root2, node2) = side
        head, head2 = (np.ascontiguousarray(x[:, : SKETCH // 256]) for x in (bits, bits2))
        xs, ys = [], []
        most = np.iinfo(np.int64).max
        partner = np.full(len(node2), most)
        keys, keys2 = lists(left.columns[-1], most), lists(right.columns[-1], most - 1)
        for k in range(0, len(node), 64):
            s = size[k : k + 64, None]
            apart = np.bitwise_count(head[k : k + 64, None] ^ head2[None]).sum(2, dtype=np.int64)
            fits = ((den + num) * apart <= (den - num) * (s + size2)) & (den * np.minimum(s, size2) >= num * np.maximum(s, size2)) & (root[k : k + 64, None] != root2)
            i, j = np.nonzero(fits)  # few are left for the rest of the bits
            apart = np.bitwise_count(bits[k + i] ^ bits2[j]).sum(1, dtype=np.int64)
            off = (den + num) * apart > (den - num) * (size[k + i] + size2[j])
            fits[i[off], j[off]] = False
            if every:
                i, j = np.nonzero(fits)
                a = keys[k + i]
                both = (a[:, :, None] == keys2[j][:, None, :]).any(2)
                here = np.where(both, a, most).min(1, initial=most) == key[0].as_py()
                i, j = i[here], j[here]
            else:
                i = np.flatnonzero(fits.any(1))
                j = np.where(fits[i], node2, most).argmin(1)
                partner = np.minimum(partner, np.where(fits, node[k : k + 64, None], most).min(0))
            xs.append(node[k + i])
            ys.append(node2[j])
        had = partner < most
        xs.append(node2[had])
        ys.append(partner[had])
        x, y = np.concatenate(xs), np.concatenate(ys)
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    return run


def _open_pairs(rows: DataFrame, nodes: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """x, y: pairs of nodes across components that share a key and may be links; rows: key, node, root; nodes: node, size, sketch, a.

    Without ``every`` some pair of each node that has one, which is enough to join most components.

    A key's nodes fall into blocks: components of more than ``BLOCK`` nodes have
    blocks of their own, the others share some.  Each two blocks that hold
    different components are a group of their own, and no component is compared
    with itself.  Sketches join the nodes when these have their groups.
    """
    per = rows.groupBy("key", "root").agg(F.count("*").alias("n")).select("*", F.when(F.col("n") > BLOCK, F.col("root")).otherwise(F.lit(0)).alias("own"))
    shelf = stored(per.groupBy("key", "own").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")))
    mixed = shelf.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key")
    block = stored(shelf.join(mixed, "key", "left_semi").select("key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no")))
    other = block.select(F.col("key").alias("key2"), F.col("own").alias("own2"), F.col("no").alias("no2"))
    first, second = F.struct("own", "no"), F.struct("own2", "no2")
    tasks = stored(block.join(other, F.col("key") == F.col("key2")).where((first <= second) & ((F.col("own") != F.col("own2")) | (F.col("own") == 0))).drop("key2"))
    places = stored(per.select("key", "root", "own").join(shelf.select("key", "own", "blocks"), ["key", "own"]))
    placed = stored(rows.join(places, ["key", "root"]).select("key", "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("no"), "node", "root"))
    cell, names = ["key", "own", "no", "own2", "no2"], ["sketch", "size", "root", "node", "a"]
    left = placed.join(tasks, ["key", "own", "no"]).join(nodes, "node").select(*cell, *names)
    again = placed.select(F.col("key").alias("key2"), F.col("own").alias("to"), F.col("no").alias("at"), "node", "root")
    right = again.join(tasks.where(first < second), (F.col("key2") == F.col("key")) & (F.col("to") == F.col("own2")) & (F.col("at") == F.col("no2"))).join(nodes, "node").select(*[F.col(c).alias(f"r_{c}") for c in cell], *[F.col(c).alias(f"{c}2") for c in names])
    near = left.groupBy(*cell).cogroup(right.groupBy(*[f"r_{c}" for c in cell])).applyInArrow(_near_pairs(num, den, every), "x long, y long")
    if every:
        return near.distinct()
    least = near.select(F.inline(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other"))))).groupBy("node").agg(F.min("other").alias("other"))
    return least.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each linked node and the least node it reaches, from links (u, v).

    Alternating large-star and small-star steps until the links stay the same;
    nothing reaches the driver but counts.  Minima are pre-aggregated and lie in
    tables of their own, so Spark can split a node with many links over tasks.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = e.count()
    while n:
        two = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        before, e = (n, e), stored(small.select("x.u", "x.v").where("u <> v").distinct().coalesce(n // LINKS + 1))
        n = e.count()
        if n == before[0] and e.join(before[1], ["u", "v"], "left_anti").isEmpty():
            break
    return e


def cluster(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: links have den * |both| >= num * |either|."""
    d = docs.select("doc_id", "text")
    sig = stored(d.mapInArrow(tidy(_signatures(words)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, keys array<long>"))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys")))
    stars = _link(d, classes, words, num, den)
    # an id with several texts joins their classes
    several = stored(full.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("u")).where("u > v").select("doc_id", "v"))
    if not several.isEmpty():
        stars = components(stars.unionAll(full.select("doc_id", "node").join(several, "doc_id").select(F.col("node").alias("u"), "v").distinct()))
    rooted = stored(classes.select("node", "low").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("lowest")))
    whole = stored(rooted.join(lowest, "root").select("node", "lowest"))
    out = sig.select("doc_id", "n_shingles", "node").join(whole, "node", "left")
    named = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", named).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _link(d: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Star links (u, v) of the confirmed candidates' components."""
    none = d.sparkSession.createDataFrame([], "u long, v long")
    each = classes.select("node", F.posexplode("keys").alias("no", "key"))
    # keys, then buckets, that more than one node has; in tables of their own, so that Spark can split a frequent one over tasks
    shared = stored(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    some = each.join(shared, "key", "left_semi")
    sides = some.groupBy("node").agg(F.collect_set(F.when(F.col("no") < SIDE, F.col("key"))).alias("a"), F.collect_set(F.when(F.col("no") >= SIDE, F.col("key"))).alias("b"))
    sides = stored(sides.where("size(a) > 0 and size(b) > 0"))
    tables = sides.select("node", F.explode("a").alias("x"), "b").select("node", "x", F.explode("b").alias("y")).select("node", F.xxhash64("x", "y").alias("bucket"))
    ends = stored(tables.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"))
    buckets = stored(tables.join(ends, "bucket"))
    if buckets.isEmpty():
        return none
    wanted = stored(classes.select("node", F.col("low").alias("doc_id")).join(buckets.select("node").distinct(), "node", "left_semi"))
    sets = _wanted_sets(d, wanted, words)
    pairs = buckets.select("node", F.when(F.col("node") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other")).groupBy("node").agg(F.min("other").alias("other"))
    pairs = stored(pairs.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct())
    cells = F.lit(max(1, pairs.count() // TOGETHER))
    good = _confirmed(pairs, sets, F.lit(0).cast("long"), F.pmod(F.xxhash64("y"), cells), num, den)
    stars = none if good.isEmpty() else components(good)
    # what is still apart: first some pair of each node, which leaves few components apart, then all pairs
    for every in (False, True):
        b = stored(buckets.select("bucket", "node").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
        split = stored(b.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket"))
        if split.isEmpty():
            break
        opened = stored(b.join(split, "bucket", "left_semi").select("node", "root").distinct())
        own = stored(sides.select("node", "a").join(opened, "node").join(sets.select("node", "size", "sketch"), "node"))
        rows, nodes = own.select(F.explode("a").alias("key"), "node", "root"), own.select("node", "size", "sketch", "a")
        more = stored(_open_pairs(rows, nodes, num, den, every).join(pairs, ["x", "y"], "left_anti"))
        if more.isEmpty():
            continue
        blocks = F.lit(max(1, more.select(F.explode(F.array("x", "y")).alias("n")).distinct().count() // BLOCK))
        good = _confirmed(more, sets, F.pmod(F.xxhash64("x", F.lit(1)), blocks), F.pmod(F.xxhash64("y", F.lit(2)), blocks), num, den)
        pairs = pairs.unionAll(more)
        if not good.isEmpty():
            stars = components(stars.unionAll(good))
    return stars


def query(docs: DataFrame) -> DataFrame:
    return cluster(docs)


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group; null ids stay."""
    c = cluster(docs, words, num, den)
    out = docs.join(c.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    ids = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("m")).first()
    if ids["n"] == ids["m"]:
        return out
    # repeated rows of a kept document: equal ids and texts stay once
    return out.where("doc_id is null").unionAll(out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, array_to_string(t[p:p+2], ' ') as g from (select doc_id, t, unnest(range(1, len(t) - 1)) as p from w where len(t) >= 3)
    union all select doc_id, array_to_string(t, ' ') from w where len(t) between 1 and 2)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select u, v from common join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) as (
  select doc_id, doc_id from documents
  union select e.u, r.root from r join e on e.v = r.doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, min(r.root) as component_id, d.doc_id = min(r.root) as kept
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n
"""

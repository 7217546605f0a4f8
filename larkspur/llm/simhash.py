"""SimHash fingerprints of documents and the search for near ones.

Terms are runs of five words.  Every occurrence of a term votes on 128 signed
bits with the term's length in letters as its weight, so long words count for
more than particles and no corpus statistics are needed: fingerprints of
different corpora can be compared.

All votes of a text are 64 sums.  Each sum holds two bits' counters, 32 bits
apart, so that plain long additions in generated code do the counting; a text
may hold up to 2**32 / 5 letters.

Defined cases: a null text counts as empty; an empty text has no votes and the
zero fingerprint; a text of fewer than five words is one term; equal texts have
equal fingerprints; rows repeat as they come; ``next`` follows (doc_id, text)
order with null ids first and, after the last row, begins again; a lone row
follows itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_SET, durable, settle, text_of

TERM = 5
LANES = 32
BITS = 128
SEEDS = (11, 23)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ``hi``, ``lo``: the 128-bit fingerprint of ``text``; a key is one text.

    The terms are summed where they are made: rows with the same keys have to be
    neighbours only if the caller has them so, else Spark shuffles partial sums.
    """
    d = settle(texts, *keys, F.array_remove(F.split(text, f"[{BLANK_SET}]"), "").alias("words"))
    # 58 bits of hash and, in the low six, the word's length
    d = settle(d, *keys, F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(-64)).bitwiseOR(F.least(F.char_length(w), F.lit(63)).cast("long"))).alias("h"))
    n = F.size("h")
    d = d.select(*keys, "h", F.explode(F.expr(f"sequence(0, greatest(size(h) - {TERM}, 0))")).alias("p"))
    at = [f"get(h, p{'' if k == 0 else f' + {k}'})" for k in range(TERM)]
    weight = " + ".join(f"coalesce({x} & 63L, 0L)" for x in at)
    term = ", ".join(at)
    d = d.select(*keys, F.expr(f"cast({weight} as bigint)").alias("w"), *[F.expr(f"xxhash64({term}, {s})").alias(f"t{s}") for s in SEEDS])
    lane = lambda s, k: F.sum(F.expr(f"(shiftright(t{s}, {k}) & 4294967297L) * w"))
    sums = [lane(s, k).alias(f"s{s}_{k}") for s in SEEDS for k in range(LANES)]
    v = d.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)

    def word(s: int) -> Column:
        low = [F.expr(f"case when 2 * (s{s}_{k} & 4294967295L) > all then {1 << k}L else 0L end") for k in range(LANES)]
        high = [F.expr(f"case when 2 * shiftrightunsigned(s{s}_{k}, 32) > all then shiftleft(1L, {k + LANES}) else 0L end") for k in range(LANES)]
        out = low[0]
        for x in [*low[1:], *high]:
            out = out.bitwiseOR(x)
        return out

    return v.select(*keys, word(SEEDS[0]).alias("hi"), word(SEEDS[1]).alias("lo"))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Bits in which two fingerprints differ."""
    return F.expr(f"bit_count({a[0]} ^ {b[0]}) + bit_count({a[1]} ^ {b[1]})")


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def as_text(hi: str = "hi", lo: str = "lo") -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def _tables(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """A row for each block table: its key holds all blocks but ``radius``."""
    width = BITS // blocks
    block = []
    for k in range(blocks):
        word, shift = ("hi", k * width) if k * width < 64 else ("lo", k * width - 64)
        block.append(f"(shiftrightunsigned({word}, {shift}) & {(1 << width) - 1}L)")
    keep = list(combinations(range(blocks), blocks - radius))
    keys = [f"named_struct('no', {no}, 'key', xxhash64({', '.join(block[k] for k in ks)}))" for no, ks in enumerate(keep)]
    return fps.select("hi", "lo", F.inline(F.expr(f"array({', '.join(keys)})")))


def near(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 8) -> DataFrame:
    """All pairs of distinct fingerprints (q_hi, q_lo, hi, lo) within ``radius`` bits.

    Exact: of ``blocks`` blocks at most ``radius`` can differ, so some table's key
    is the same.  Both sides are reduced to distinct fingerprints first, so any
    number of equal texts is one row; the caller joins documents back on them.
    """
    if BITS % blocks or 64 % (BITS // blocks) or not 0 <= radius < blocks:
        raise ValueError("blocks must divide each 64-bit half, and radius be less than blocks")
    q = _tables(queries.select("hi", "lo").distinct(), radius, blocks).withColumnsRenamed({"hi": "q_hi", "lo": "q_lo"})
    i = _tables(index.select("hi", "lo").distinct(), radius, blocks)
    pairs = q.join(i, ["no", "key"]).where(distance(("q_hi", "q_lo"), ("hi", "lo")) <= radius)
    return pairs.select("q_hi", "q_lo", "hi", "lo").distinct()


def with_next(docs: DataFrame, rows_per_bucket: int = 2000, most_buckets: int = 100_000) -> DataFrame:
    """bucket, seq, doc_id, text, next_text, halo for each row and the one after it.

    One shuffle of the texts: ids are cut into ranges of about equal counts, and
    the first rows of each range also go, as ``halo`` rows, to the range before.
    Only range limits reach the driver, ``most_buckets`` of them at most.
    """
    d = docs.select("doc_id", text_of().alias("text")).withColumn("sort_id", F.coalesce("doc_id", F.lit(-(2**63))))
    ids = d.select("sort_id")
    n = max(1, min(most_buckets, ceil(ids.count() / rows_per_bucket)))
    cut = ids.agg(F.percentile_approx("sort_id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = sorted(set(cut)) if n > 1 else []

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < F.col("sort_id")))

    if cuts:  # a count over every k-th limit, then over the k limits there
        step = isqrt(len(cuts)) + 1
        ends = [cuts[min(k + step, len(cuts)) - 1] for k in range(0, len(cuts), step)]
        runs = [cuts[k : k + step] for k in range(0, len(cuts), step)]
        d = settle(d, "doc_id", "text", "sort_id", below(F.lit(ends)).alias("run"))
        inner = F.coalesce(F.get(F.lit(runs), F.col("run")), F.array().cast("array<bigint>"))
        b = (F.col("run") * step + below(inner)).cast("int")
        d = settle(d, "doc_id", "text", "sort_id", F.least(b, F.lit(len(cuts))).alias("bucket"))
        keyed = d.select("sort_id", "bucket")
    else:
        d = d.withColumn("bucket", F.lit(0))
        keyed = d.select("sort_id", "bucket")
    firsts = {r[0]: r[1] for r in keyed.groupBy("bucket").agg(F.min("sort_id")).collect()}
    used = sorted(firsts)
    if not used:
        used, firsts = [0], {0: 0}
    first = [firsts.get(k) for k in range(used[-1] + 1)]
    before = [None] * (used[-1] + 1)
    for a, b in zip(used, used[1:]):
        before[b] = a
    longs = lambda xs, kind: F.lit([x if x is not None else None for x in xs] if any(x is not None for x in xs) else [0]).cast(f"array<{kind}>")
    here = lambda b, halo, wrap: F.struct(b.cast("int").alias("bucket"), F.lit(halo).alias("halo"), F.lit(wrap).alias("wrap"))
    places = [here(F.col("bucket"), False, 0)]
    if len(used) > 1:
        back = F.get(longs(before, "int"), F.col("bucket"))
        places.append(F.when((F.get(longs(first, "bigint"), F.col("bucket")) == F.col("sort_id")) & back.isNotNull(), here(back, True, 0)))
    places.append(F.when(F.col("sort_id") == firsts[used[0]], here(F.lit(used[-1]), True, 1)))
    d = d.select("doc_id", "text", "sort_id", F.inline(F.array_compact(F.array(*places))))
    w = Window.partitionBy("bucket").orderBy("wrap", "sort_id", "halo", "text")
    return d.select("bucket", F.row_number().over(w).alias("seq"), "doc_id", "text", F.lead("text").over(w).alias("next_text"), "halo")


def query(docs: DataFrame, radius: int = 3, blocks: int = 4, every: int = 50) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likenesses, and ``n_near``.

    ``n_near`` is, where ``every`` divides the id, the number of other
    fingerprints of all documents within ``radius`` bits, and else null.
    """
    d = with_next(docs)
    n, half = F.char_length("text"), F.expr("cast(floor(char_length(text) / 2) as int)")
    edited = F.when(~F.col("halo"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    d = d.select("bucket", "seq", "doc_id", "halo", "text", edited.alias("edited"), n.cast("long").alias("n_chars"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"), F.sha2("edited", 256).alias("sha")))
    d = d.select("bucket", "seq", "doc_id", "halo", "n_chars", F.inline(both)).where("body is not null")
    keys = ["bucket", "seq", "kind", "doc_id", "halo", "n_chars", "sha"]
    f = fingerprints(d, keys, "body")
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    own = f.groupBy("bucket", "seq").agg(
        F.max("doc_id").alias("doc_id"), F.max("halo").alias("halo"), F.max("n_chars").alias("n_chars"), F.max("sha").alias("edited_sha256"),
        pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"), pick("hi", 1).alias("e_hi"), pick("lo", 1).alias("e_lo"),
    )
    w = Window.partitionBy("bucket").orderBy("seq")
    own = own.select("*", F.lead("hi").over(w).alias("n_hi"), F.lead("lo").over(w).alias("n_lo")).where("not halo")
    own = durable(own)
    asked = F.col("doc_id") % every == 0
    found = near(own.where(asked), own, radius, blocks).where("q_hi <> hi or q_lo <> lo").groupBy("q_hi", "q_lo").agg(F.count("*").alias("found"))
    found = durable(found).withColumnsRenamed({"q_hi": "f_hi", "q_lo": "f_lo"})
    own = own.join(found, asked & (F.col("hi") == F.col("f_hi")) & (F.col("lo") == F.col("f_lo")), "left")
    return own.select(
        F.when(asked, F.coalesce("found", F.lit(0)).cast("long")).alias("n_near"),
        "doc_id", "n_chars", "edited_sha256",
        as_text().alias("fingerprint"), as_text("e_hi", "e_lo").alias("edited_fingerprint"),
        likeness(("hi", "lo"), ("e_hi", "e_lo")).alias("near_edited"),
        likeness(("hi", "lo"), ("n_hi", "n_lo")).alias("near_next"),
    )

"""Fill-in-the-middle, ranked lexical search and SimHash near-dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import impact, infill, popcount

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = r"[^\x20\x09-\x0D]+"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that clash with those of the operators."""
    long = "Wörd über " * 150_000
    rows = [
        (1, "a b c d e f g h i j", "en", "s1", 19, "x", 1), (1, "a b c d e f g h i j", "en", "s1", 19, "x", 1), (1, "another text of the same id", "en", "s1", 19, "x", 1),
        (2, None, None, None, None, None, None), (3, "", "en", "s1", 0, "y", 2), (None, "a b c d e f g h i j", "en", None, 5, None, 3), (4, long, "en", "s2", len(long), "z", 4),
        (5, " \n\t ", "en", "s2", 4, "z", 5), (6, "A b C d e f g h i j", "de", "s2", 19, "z", 6), (7, "holds <S> a mark", "de", "s2", 16, "z", 6), (8, "two words", "en", "s", 9, "z", 7), (None, "alone without id", "en", "s", 9, "z", 7),
    ]
    return spark.createDataFrame(rows, DOCS + ", infill string, fp long")


def test_infill_cuts_where_its_draws_say(spark):
    docs = odd_docs(spark)
    got = infill.query(docs).collect()
    assert len(got) == 12 and infill.query(docs.where("false")).collect() == []
    want = []
    for r in docs.collect():
        t, h = r.text or "", hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted(x % (len(t) + 1) for x in h[:2])
        form = "plain" if not t or "<S>" in t or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, t)]
        want.append((r.doc_id, len(t), form, *((None, None) if form == "plain" else (a, b - a)), *sha))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = infill.transform(docs)
    assert whole.columns == [*docs.columns, "infill_"] and whole.where("infill_.form <> 'plain'").count() > 4


def test_infill_by_other_units_restores_every_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = infill.transform(docs, unit=r"\w+\s*", rate=100, spm=50).select("text", "infill.*").withColumn("back", infill.restored(F.col("output"), F.col("form")))
    rows = words.collect()
    assert {r.form for r in rows} >= {"psm", "spm"}
    for r in rows:
        assert r.back == r.text
        if r.form != "plain":
            ends = {0, *(m.end() for m in re.finditer(r"\w+\s*", r.text))}
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends and r.n == len(ends) - 1
    assert {r.form for r in infill.transform(docs, rate=0).select("infill.form").collect()} == {"plain"}
    with pytest.raises(ValueError):
        infill.transform(docs, rate=101)
    assert infill.rebuild("<P>a<<S>b<P<M>c", "psm") == "a<cb<P"  # pieces of marks beside marks


def ranked(docs, items, k=10):
    """Brute force of the scores' definition."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(d, Counter(term.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    many, length, df = len(bags), sum(c.total() for _, c in bags), Counter(t for _, c in bags for t in c)
    terms = {}
    for q, t in items:
        terms.setdefault(q, set()).update(term.findall((t or "").translate(LOWER)))
    out = []
    for q, ts in terms.items():
        found = []
        for d, c in bags:
            m = 10 + 90 * c.total() * many // length
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is None, d))
        out += [(q, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def test_search_ranks_as_brute_force(spark, monkeypatch):
    docs = odd_docs(spark)
    items = [(1, "A, b; two-words alone"), (2, None), (3, "ÜBER über Wörd"), (1, "mark"), (4, "unheard of"), (None, "text a"), (5, "!?")]
    asked = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, score int")
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], items)
    assert sorted(map(str, map(tuple, impact.query(docs, asked).collect()))) == want
    monkeypatch.setattr(impact, "HELD", 20)  # many groups of queries
    assert sorted(map(str, map(tuple, impact.query(docs, asked).collect()))) == want
    assert impact.query(docs.where("false"), asked).collect() == [] and impact.query(docs, asked.where("false")).collect() == []


def test_search_breaks_ties_by_id_over_many_blocks(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("a b c d e f g h".split(), k=rng.choice([3, 4])))) for i in range(5000)]
    items = [(0, "a b"), (1, "c"), (2, "a d h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = impact.rank(docs, spark.createDataFrame(items, "item_id long, text string"), 100).collect()
    assert sorted(map(str, map(tuple, got))) == ranked(rows, items, 100)


def test_bit_slices_add_and_rank():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 70)
        cols = [[rng.choice([0, 0, rng.getrandbits(rng.randint(1, 40))]) for _ in range(n)] for _ in range(rng.randint(1, 9))]
        total = []
        for c in cols:
            total = impact.added(total, [sum((x >> j & 1) << p for p, x in enumerate(c)) for j in range(41)])
        want = sorted(((sum(c[p] for c in cols), p) for p in range(n)), key=lambda x: (-x[0], x[1]))
        k = rng.randint(1, 12)
        assert sorted(impact.top(total, k), key=lambda x: (-x[0], x[1])) == [x for x in want if x[0] > 0][:k]
    big = ("Straße x1 " * 300_000).encode()
    assert impact.terms_of(big) == {"straße".encode(): 300_000, b"x1": 300_000}


def simhash(text, words=3):
    w = re.findall(BLANKS, (text or "").translate(LOWER))
    g = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(fps, radius):
    """For each fingerprint the places that it reaches."""
    x = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius):
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(x))]


def check_clusters(rows, got):
    fps = [simhash(t) for _, t in rows]
    root = roots(fps, 3)
    low = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            low[r] = min(d, low.get(r, d))
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, f"{f:016x}", low.get(r))) for (d, _), f, r in zip(rows, fps, root))


def test_near_dedup_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_clusters(rows, popcount.query(docs).collect())
    odd = odd_docs(spark)
    check_clusters([(r.doc_id, r.text) for r in odd.collect()], popcount.query(odd).collect())
    assert popcount.query(odd.where("false")).collect() == []
    kept = popcount.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 2 and kept.where("doc_id = 6").count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_links_join_what_lies_near_and_nothing_else(spark, monkeypatch, radius):
    """Chains, tight groups, and cells of more points than a block."""
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for _ in range(25):  # a walk: far ends of one component
            for k in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << k
            fps.add(f)
    base = rng.getrandbits(64)
    fps |= {base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for _ in range(600)} | {0, (1 << 64) - 1, 1 << 63, 3}
    fps = sorted(fps)
    monkeypatch.setattr(popcount, "BLOCK", 16)
    signed = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in popcount.links(signed, radius).collect()]
    assert all(0 < (u ^ v).bit_count() <= 2 * 64 for u, v in found)
    place, root = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in found:
        root[find(place[u])] = find(place[v])
    mine, want = [find(i) for i in range(len(fps))], roots(fps, radius)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_points_bound_the_distance_from_below():
    rng = random.Random(9)
    for _ in range(300):
        a = np.array([rng.getrandbits(64) for _ in range(8)], np.uint64)
        b = np.uint64(rng.getrandbits(64))
        d = popcount.manhattan(popcount.points(a), popcount.points(b))
        want = [sum(abs((int(x) >> 2 * k & 3).bit_count() - (int(b) >> 2 * k & 3).bit_count()) for k in range(32)) for x in a]
        assert d.tolist() == want and (d <= np.bitwise_count(a ^ b)).all()


def test_fingerprints_of_long_texts_are_those_of_whole_ones():
    text = " ".join(random.Random(4).choices(["Wörd", "b", "C", "dd e"], k=400_000)) + "\n"
    assert popcount.fingerprint(text.encode()) == simhash(text)
    for t in ("", " \n", "one", "one Two", "a b c", "a  b\tc d"):
        assert popcount.fingerprint(t.encode()) == simhash(t)
    assert popcount.fingerprint(b"a b", 1) == simhash("a b", 1)

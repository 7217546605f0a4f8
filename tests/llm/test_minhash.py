"""What near-dedup moves about, and the sieves that its texts pass."""

import numpy as np

from larkspur.llm import minhash


def test_no_text_takes_part_in_a_join(spark, monkeypatch):
    plans, once = [], minhash.stored

    def stored(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return once(df)

    monkeypatch.setattr(minhash, "stored", stored)
    minhash.query(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    assert any("text#" in p for p in plans) and not any("text#" in p and "Join" in p for p in plans)


def test_sieve_passes_all_that_is_wanted(spark):
    values = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 500)
    sieve = minhash._sieve(spark.createDataFrame([(int(x),) for x in values], "x long"), len(values))
    assert minhash._passes(sieve, values.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(-(1 << 63), (1 << 63) - 1, 5000)
    assert minhash._passes(sieve, others.view(np.uint64)).mean() < 0.1


def test_sets_come_once_for_repeated_rows_and_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIEVE_BITS", 64)  # nearly everything passes
    words = [f"w{i}" for i in range(40)]
    texts = [(k, " ".join(words[k % 7 :])) for k in range(60)]
    d = spark.createDataFrame(texts + texts[:30], "doc_id long, text string")
    got = minhash.cluster(d).collect()
    least = {}
    for r in got:
        least.setdefault(r["component_id"], set()).add(r["doc_id"] % 7)
    # 38 to 32 shingles: each links with its neighbour, so all are one component
    assert len(got) == 90 and least == {0: set(range(7))}

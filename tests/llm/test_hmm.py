"""The language model's recursions against plain ones on short texts."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import hmm
from larkspur.llm.textops import Lookup, word_hashes


@pytest.fixture
def model(monkeypatch):
    monkeypatch.setattr(hmm, "RUN", 3)  # texts of many runs
    rng = np.random.default_rng(2)
    row = lambda *n: (x := rng.random(n) + 0.05) / x.sum(-1, keepdims=True)
    start, move = row(hmm.STATES), row(hmm.STATES, hmm.STATES)
    vocabulary = [f"w{i}" for i in range(12)]
    h = next(word_hashes(pa.array([" ".join(vocabulary)]), endings=True))[2]
    words = np.append(h, hmm.END)
    emit = np.full((hmm.STATES, hmm.WORDS + hmm.CLASSES), 1e-4)
    emit[:, : len(words)] = row(hmm.STATES, len(words))
    pick = random.Random(4)
    texts = [" ".join(pick.choices(vocabulary, k=n)) for n in (0, 1, 2, 3, 4, 7, 9, 12, 20, 31)]
    return start, move, emit, Lookup(words, np.arange(len(words), dtype=np.int32)), texts, [[vocabulary.index(w) for w in t.split()] + [12] for t in texts]


def plain(start, move, emit, seq):
    """Log likelihood and the expected counts of one sequence, token by token."""
    alpha = [start * emit[:, seq[0]]]
    for s in seq[1:]:
        alpha.append(alpha[-1] @ move * emit[:, s])
    beta = [np.ones(len(start))]
    for s in reversed(seq[1:]):
        beta.append(move @ (emit[:, s] * beta[-1]))
    beta.reverse()
    p = alpha[-1].sum()
    gamma = [a * b / p for a, b in zip(alpha, beta)]
    xi = sum((np.outer(alpha[t], emit[:, seq[t + 1]] * beta[t + 1]) * move / p for t in range(len(seq) - 1)), np.zeros_like(move))
    return math.log(p), gamma, xi


def test_expected_counts_over_whole_texts(model):
    start, move, emit, lookup, texts, seqs = model
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = {k: {} for k in range(5)}
    for b in hmm._expect(start, move, emit, lookup)(iter([batch])):
        for r in b.to_pylist():
            got[r["kind"]][r["word"]] = r["n"]
    want = [plain(start, move, emit, s) for s in seqs]
    counts = np.zeros((13, hmm.STATES))
    for s, (_, gamma, _) in zip(seqs, want):
        for t, g in zip(s, gamma):
            counts[t] += g
    assert np.allclose([got[hmm.SYMBOL][k] for k in range(13)], counts, atol=1e-4)
    assert np.allclose([got[hmm.MOVE][k] for k in range(hmm.STATES)], sum(w[2] for w in want), atol=1e-4)
    assert np.allclose(got[hmm.START][0], sum(w[1][0] for w in want), atol=1e-4)
    assert got[hmm.LIKELY][0][:2] == pytest.approx([sum(w[0] for w in want), sum(map(len, seqs))], abs=1e-4)


def test_scores_of_whole_texts(model):
    start, move, emit, lookup, texts, seqs = model
    shares = hmm.Shares(np.ones((0, hmm.STATES), np.float32), np.ones((hmm.CLASSES, hmm.STATES)), np.ones(hmm.CLASSES))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in hmm._scores(start, move, emit, lookup, shares, np.zeros(13), np.ones(13, bool), 1.0)(iter([batch])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts))) and [r["n_tokens"] for r in rows] == list(map(len, seqs))
    assert [r["model"] for r in rows] == pytest.approx([plain(start, move, emit, s)[0] / math.log(10) for s in seqs])


def test_training_ends_by_its_gain(spark, monkeypatch):
    from larkspur.llm import hmm

    rounds, once = [], hmm._next
    monkeypatch.setattr(hmm, "_next", lambda *a: rounds.append(1) or once(*a))
    hmm.query(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert 2 < len(rounds) < hmm.ROUNDS


def test_coded_texts_give_the_same_counts(model, monkeypatch):
    start, move, emit, lookup, texts, seqs = model
    monkeypatch.setattr(hmm, "TOGETHER", 20)  # several parts of a batch
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    plain, coded = ([r for b in run for r in b.to_pylist() if r["kind"] != hmm.TAIL] for run in (hmm._expect(start, move, emit, lookup)(iter([batch])), hmm._expect_coded(start, move, emit)(hmm._coded(lookup)(iter([batch])))))
    assert [(r["kind"], r["word"]) for r in plain] == [(r["kind"], r["word"]) for r in coded]
    assert np.allclose([r["n"] for r in plain], [r["n"] for r in coded], atol=1e-4)


def test_most_rounds_count_symbols_alone(spark, monkeypatch):
    """Counts of all words by state, which are what a round shuffles and writes, are made in a few rounds only."""
    rounds = {"_expect": 0, "_expect_coded": 0}

    def told(name):
        once = getattr(hmm, name)

        def run(*a):
            rounds[name] += 1
            return once(*a)

        monkeypatch.setattr(hmm, name, run)

    for name in rounds:
        told(name)
    hmm.query(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert rounds["_expect_coded"] > 2 and 2 <= rounds["_expect"] <= 3


def test_codes_give_back_what_the_steps_need(model):
    """Words with a symbol, held ones without, and others, read back from the stored codes; texts themselves are looked up once."""
    _, _, _, lookup, texts, _ = model
    held = np.random.default_rng(5).integers(0, 1 << 63, hmm.WORDS + 9).astype(np.uint64)
    held[:6], held[-4:] = lookup.keys[lookup.values >= 0][:6], lookup.keys[lookup.values >= 0][6:10]
    known = Lookup(held, np.arange(len(held), dtype=np.int32))
    want = list(hmm._sequences(pa.array(texts), known))
    [codes] = hmm._coded(known)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])]))
    assert codes.column("doc_id").to_pylist() == list(range(len(texts)))
    [(first, lengths, h, rank)] = hmm._sequences(pa.StructArray.from_arrays(codes.columns[:3], ["sym", "tail", "rest"]), hmm.Known(held))
    assert first == 0 and lengths.tolist() == want[0][1].tolist() and rank.tolist() == want[0][3].tolist()
    tail = (rank < 0) | (rank >= hmm.WORDS)
    assert {-1, *range(hmm.WORDS)} & set(rank.tolist()) and (rank >= hmm.WORDS).any() and h[tail].tolist() == want[0][2][tail].tolist()


def test_no_text_takes_part_in_a_join(spark, monkeypatch):
    """Rounds, joins and scores take stored codes."""
    plans, keep = [], hmm.stored
    monkeypatch.setattr(hmm, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    hmm.query(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), most=100)
    assert any("Join" in p for p in plans) and not any("Join" in p and "text#" in p and "sym#" not in p for p in plans)


def test_held_words_are_summed_by_rank(model, monkeypatch):
    """A held word without a symbol comes by its rank, another by its hash; both with the counts of its class's symbols."""
    start, move, emit, lookup, texts, seqs = model
    monkeypatch.setattr(hmm, "BUFFER", 8)  # several rows of a word
    w = lookup.keys[lookup.values >= 0][np.argsort(lookup.values[lookup.values >= 0])]
    rank = np.array([0, hmm.WORDS, hmm.WORDS + 1, hmm.WORDS + 2], np.int32)
    some = Lookup(w[:4], rank)  # one symbol, three held words; all others are not held
    sums = {}
    for b in hmm._expect(start, move, np.maximum(emit, 1e-3), some)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        for r in b.to_pylist():
            if r["kind"] in (hmm.TAIL, hmm.HELD):
                sums[r["kind"], r["word"]] = sums.get((r["kind"], r["word"]), 0) + r["c"]
    many = np.bincount(np.concatenate(seqs))
    want = {(hmm.HELD, hmm.WORDS + i - 1): many[i] for i in (1, 2, 3)} | {(hmm.TAIL, int(w[i].view(np.int64))): many[i] for i in range(4, 13)}
    assert sums == want


def test_released_steps_leave_no_shuffle_files(spark):
    """What finished steps shuffled is deleted once nothing refers to them."""
    import time

    from larkspur.llm.common import released

    there = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    released(spark)
    time.sleep(1)
    before = there()
    spark.range(1000).repartition(7, "id").write.format("noop").mode("overwrite").save()
    for _ in range(10):
        released(spark)
        time.sleep(0.3)
    assert there() <= before

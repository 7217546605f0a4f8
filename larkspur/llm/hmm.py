"""A hidden Markov language model of words, trained by Baum-Welch.

Symbols are the ``WORDS`` most frequent tokens and, for all others, 256 classes
by a word's last two bytes; within a class each word has, in each state, the
smoothed share that its own expected counts there give it.  So the model is a
distribution over all texts, unknown words included.

Training reads all training texts in each round: every partition adds up its
expected counts, Spark sums them, and the driver turns those of symbols (at most
WORDS + 256 rows) into the next model.  The first rounds read stored symbols and
count these alone; they begin with what about ``WARM`` texts give, by the same rounds.
Once they gain nothing more, rounds sum all words by state:
those without a symbol stay a distributed table, by word its count and the states'
parts of it, 16 bits each.  The shares of words that no worker holds take part as soon as
those held have theirs; only rounds of all words can end training.  Texts are worked on in runs of ``RUN`` tokens, many at once;
transfer matrices of the runs carry the states over their edges, so training
and scoring follow whole texts: every transition counts, and the scaled forward
recursion is exact.  Both kinds of rounds end after ``ROUNDS``, or earlier when
the log likelihood gains less than ``GAIN`` a token.

Counts of all words stay distributed; a worker holds those of the most frequent
``KNOWN`` words at most, and the rest are joined to the texts that have them.  A
word is known by a 64-bit hash.

Defined cases: a null text counts as empty and is one end token; without any
training text all probabilities are those of the smoothing; rows repeat as
they come; a long text is many runs and is learnt from and scored whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored, tidy
from .textops import Lookup, rows_of_words, word_hashes

STATES = 8
WORDS = 8192
CLASSES = 256
KNOWN = 1 << 20
RUN = 256
#: So many at most; ``GAIN`` ends training long before.
ROUNDS = 100
#: Nats a token.
GAIN = 0.001
#: A round of symbols that gains less than this many is followed by one that sums words too, for it may be the last.
NEAR = 10 * GAIN
SEEDS = 400
#: Texts, about, whose rounds of symbols come before those over all texts.
WARM = 8192
END = np.uint64(0x6C6172_6B7370_7572)
#: Words counted at once in a worker.
BUFFER = 1 << 20
#: Tokens of coded texts worked on at once.
TOGETHER = 1 << 18
SMOOTH = 0.5
#: Part of a word's count that goes to every state alike.
EVEN = 0.02
#: Columns with the states' parts of a word's count, 16 bits each, four to a column.
_PARTS = ("a", "b")
_FULL = 65535


def _training(fold: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != fold


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often, merged over about ``BUFFER`` words at a time."""
    held, n = [], 0

    def out():
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["word", "c"])

    for b in batches:
        for _, _, h in word_hashes(b.column(0), endings=True):
            held.append(h)
            n += len(h)
            if n >= BUFFER:
                yield out()
                held, n = [], 0
    if n:
        yield out()


def _symbols(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Symbols of words: their rank, or the class of their ending."""
    return np.where((rank >= 0) & (rank < WORDS), rank, WORDS + (h & np.uint64(255)).astype(np.int32))


class Known:
    """The held words by rank, for texts whose ranks are stored."""

    def __init__(self, words: np.ndarray):
        self.words = words


def _sequences(texts: pa.Array, lookup: Lookup | Known):
    """Yields (first, lengths, hashes, ranks) with the end token after each text; of ``_coded`` texts the hashes of symbols are not given."""
    if pa.types.is_struct(texts.type):
        yield from _decoded(texts, lookup)
        return
    for first, counts, h in rows_of_words(texts, endings=True):
        ends = np.cumsum(counts)
        full = np.insert(h, ends, END)
        yield first, counts + 1, full, lookup(full)


def _runs(lengths: np.ndarray, run: int):
    """Starts and lengths of runs of at most ``run`` tokens, longest first, and whether each begins its text."""
    per = -(-lengths // run)
    text = np.repeat(np.arange(len(lengths)), per)
    no = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = (np.cumsum(lengths) - lengths)[text] + no * run
    size = np.minimum(run, lengths[text] - no * run)
    return text, no, start, size


def _packed(rows: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    part = np.clip(np.rint(rows[:, :STATES] / c[:, None] * _FULL), 0, _FULL).astype(np.uint64)
    return [sum(part[:, 4 * j + i] << np.uint64(16 * i) for i in range(4)).view(np.int64) for j in range(2)]


def _unpacked(got: pa.Table | pa.StructArray, c: np.ndarray) -> np.ndarray:
    """Expected counts (word, state)."""
    column = got.column if isinstance(got, pa.Table) else got.field
    parts = [column(x).to_numpy().view(np.uint64) for x in _PARTS]
    return np.stack([((parts[s // 4] >> np.uint64(16 * (s % 4))) & np.uint64(_FULL)) * (c / _FULL) for s in range(STATES)], 1)


def _per_state(e: np.ndarray, c: np.ndarray, word: np.ndarray, ratio: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Each word's share of its class by state, from its expected counts; over a class and one unseen word they add up to 1."""
    k = word & 255
    return (((e + EVEN * c[:, None]) / ratio[k] + SMOOTH) / whole[k][:, None]).astype(np.float32)


def _ratio(sums_e: np.ndarray, n_class: np.ndarray) -> np.ndarray:
    """(class, state): the part of the class's tokens that the state has, with ``EVEN`` put on it."""
    n = np.maximum(n_class, 1e-9)
    return np.where(n_class[:, None] > 0.5, sums_e[:, WORDS:].T / n[:, None] + EVEN, 1.0)


class Shares:
    """Shares by state of the words without a symbol: those held, and those that come with a batch's texts."""

    def __init__(self, held: np.ndarray, ratio: np.ndarray, whole: np.ndarray):
        self.held, self.ratio, self.whole = held, ratio, whole

    def of(self, met: pa.Array | None):
        """Lookup, counts and shares of the words in a batch's ``met`` lists."""
        flat = met.flatten() if met is not None else None
        if flat is None or not len(flat):
            return Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int32)), np.zeros(1), np.ones((1, STATES), np.float32)
        word, first = np.unique(flat.field("word").to_numpy(), return_index=True)
        c = flat.field("c").to_numpy()
        e, c = _unpacked(flat, c)[first], c[first]
        return Lookup(word.view(np.uint64), np.arange(len(word), dtype=np.int32)), c, _per_state(e, c, word, self.ratio, self.whole)

    def put(self, p: np.ndarray, h: np.ndarray, rank: np.ndarray, near: np.ndarray, own: np.ndarray) -> None:
        """Multiply the classes' probabilities (state, token) by the words' shares; ``near`` are places in ``own``."""
        tail = np.flatnonzero(rank >= WORDS)
        p[:, tail] *= self.held[rank[tail] - WORDS].T
        rest = np.flatnonzero(rank < 0)
        met = near[rest] >= 0
        p[:, rest[met]] *= own[near[rest[met]]].T
        new = rest[~met]
        p[:, new] *= (SMOOTH / self.whole[(h[new] & np.uint64(255)).astype(np.int64)]).astype(np.float32)


def _near(lookup: Lookup, h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places in a batch's own words of the tokens that are not held."""
    out = np.full(len(h), -1, np.int32)
    rest = np.flatnonzero(rank < 0)
    out[rest] = lookup(h[rest])
    return out


def _merged(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of (words, rows) pairs and the sums of their rows."""
    word, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    rows = np.concatenate([x[1] for x in held])
    return word, np.stack([np.bincount(at, rows[:, s], len(word)) for s in range(rows.shape[1])], 1)


def _sums(kind: int, at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    n = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), STATES).cast(pa.list_(pa.float64()))
    none = pa.array(np.zeros(len(at), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array(at.astype(np.int64)), none, none, none, n], names=["kind", "word", "c", *_PARTS, "n"])


def _added(held: list) -> tuple[np.ndarray, np.ndarray]:
    """``_merged`` of (ranks, states by token) pairs, a row with the number of tokens at its end."""
    at = np.concatenate([x[0] for x in held])
    c = np.bincount(at)
    rank = np.flatnonzero(c)
    states = [np.bincount(at, np.concatenate([x[1][s] for x in held]))[rank] for s in range(STATES)]
    return rank, np.stack([*states, c[rank]], 1)


def _tail_sums(kind: int, word: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    c = np.rint(rows[:, STATES])
    cols = [pa.array(np.full(len(word), kind, np.int8)), pa.array(word.view(np.int64)), pa.array(c.astype(np.int64)), *map(pa.array, _packed(rows, c))]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(word), pa.list_(pa.float64()))], names=["kind", "word", "c", *_PARTS, "n"])


def _summed(found: DataFrame) -> DataFrame:
    """Rows of ``_expect`` added up by kind and word; partitions hold a word about once, so nothing is added before the shuffle."""
    part = lambda s: F.shiftrightunsigned(_PARTS[s // 4], 16 * (s % 4)).bitwiseAND(F.lit(_FULL))
    sums = [F.sum(F.col("c") * part(s)).alias(f"p{s}") for s in range(STATES)] + [F.sum(F.get("n", F.lit(s))).alias(f"n{s}") for s in range(STATES)]
    d = found.repartition("kind", "word").groupBy("kind", "word").agg(F.sum("c").alias("c"), *sums)
    again = lambda s: F.shiftleft(F.expr(f"(p{s} + c div 2) div greatest(c, 1)"), 16 * (s % 4))
    packed = [reduce(lambda x, y: x.bitwiseOR(y), [again(4 * j + i) for i in range(4)]).alias(x) for j, x in enumerate(_PARTS)]
    return d.select("kind", "word", "c", *packed, F.when(~F.col("kind").isin(TAIL, HELD), F.array(*[f"n{s}" for s in range(STATES)])).alias("n"))


#: What a row of sums is of; ``word`` is the hash of a word that is not held (``TAIL``), the rank of one that is and has no symbol (``HELD``).
SYMBOL, MOVE, START, TAIL, LIKELY, HELD = range(6)


def _laid(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs, longest first: how many reach each step, and where a step's tokens begin when all lie step by step."""
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    return live, np.concatenate([[0], np.cumsum(live)])


def _by_step(prob: np.ndarray, at: np.ndarray, live: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs' tokens step by step, and their probabilities (state, token)."""
    place = np.empty(begin[-1], np.int64)
    for t, n in enumerate(live.tolist()):
        np.add(at[:n], t, out=place[begin[t] : begin[t + 1]])
    return place, prob.take(place, axis=1)


def _chances(table: np.ndarray, sym: np.ndarray, put=None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens' probabilities (state, token) over the largest of each, and the logarithms of those; ``put`` brings in the words' shares."""
    prob = table.take(sym, axis=1)
    if put:
        put(prob)
    top = prob.max(0)
    prob /= top
    return prob, np.log(top, dtype=np.float64)


def _edges(start, move, prob, per, text, no, at, size, back: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each run the states before its first token, and, with ``back``, what follows its last one tells about the states there.

    ``per`` has the runs of each text.  Only runs of texts of several runs are
    looked at; first runs have no states before them, last ones ones.
    """
    k = len(start)
    before, after = np.zeros((len(at), k)), np.ones((len(at), k))
    many = np.flatnonzero(per[text] > (1 if back else no + 1))
    if not len(many):
        return before, after
    many = many[np.argsort(-size[many], kind="stable")]
    first = no[many] == 0
    live, begin = _laid(size[many])
    _, p = _by_step(prob, at[many], live, begin)
    turn = np.ascontiguousarray(move.T, np.float32)
    # x[j, i, r]: the part of run r's state i that is state j at its end
    x = np.where(first, np.eye(k, dtype=np.float32)[:, :, None], turn[:, :, None])
    for t, n in enumerate(live.tolist()):
        if n < x.shape[2]:
            done, x = x[:, :, n:], np.ascontiguousarray(x[:, :, :n])
            ends.append(done)
        elif not t:
            ends = []
        if t:
            x = (turn @ x.reshape(k, k * n)).reshape(k, k, n)
        x *= p[:, None, begin[t] : begin[t + 1]]
        if t % 4 == 3:
            x /= x.sum((0, 1))
    x = np.concatenate([x, *reversed(ends)], 2).transpose(2, 1, 0)
    x = x / x.sum((1, 2))[:, None, None]
    where = np.zeros(len(at), np.int64)
    where[many] = np.arange(len(many))
    head = np.cumsum(per) - per
    a, b = np.tile(start, (len(per), 1)), np.ones((len(per), k))
    for j in range(int(per.max()) - 1):
        rows = np.flatnonzero(per > j + 1)
        y = np.einsum("ij,ijk->ik", a[rows], x[where[head[rows] + j]])
        before[head[rows] + j + 1] = a[rows] = y / y.sum(1, keepdims=True)
    for j in range(int(per.max()) - 1 if back else 0, 0, -1):
        rows = np.flatnonzero(per > j)
        y = np.einsum("ijk,ik->ij", x[where[head[rows] + j]], b[rows])
        after[head[rows] + j - 1] = b[rows] = y / y.sum(1, keepdims=True)
    return before, after


class Sums:
    """Expected counts of Baum-Welch over texts, added up."""

    def __init__(self, start, move, n_symbols: int):
        k = len(start)
        self.start, self.move = start, move
        self.turn, self.step = np.ascontiguousarray(move.T, np.float32), np.ascontiguousarray(move, np.float32)
        self.e, self.m, self.s, self.likely = np.zeros((k, n_symbols)), np.zeros((k, k)), np.zeros(k), np.zeros(k)

    def add(self, lengths: np.ndarray, sym: np.ndarray, prob: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds texts of ``lengths`` tokens, given ``_chances``; gives tokens in some order and their states' probabilities (state, token)."""
        text, no, at, size = _runs(lengths, RUN)
        before, after = _edges(self.start, self.move, prob, -(-lengths // RUN), text, no, at, size)
        order = np.argsort(-size, kind="stable")
        at, size, later = at[order], size[order], no[order] > 0
        before, after = np.ascontiguousarray(before[order].T, np.float32), np.ascontiguousarray(after[order].T, np.float32)
        live, begin = _laid(size)
        place, p = _by_step(prob, at, live, begin)
        alpha, scale = np.empty_like(p), np.empty(p.shape[1], np.float32)
        a = np.where(later, self.turn @ before, self.start.astype(np.float32)[:, None])
        for t, n in enumerate(live.tolist()):
            here = slice(begin[t], begin[t + 1])
            a = np.multiply(self.turn @ a[:, :n] if t else a, p[:, here], out=alpha[:, here])
            a.sum(0, out=scale[here])
            a /= scale[here]
        self.likely[0] += np.log(scale, dtype=np.float64).sum() + logs.sum()
        self.likely[1] += len(sym)
        beta, joint = after[:, : live[-1]], np.zeros_like(self.m)
        for t in range(len(live) - 1, -1, -1):
            n, here = live[t], slice(begin[t], begin[t + 1])
            if beta.shape[1] < n:
                beta = np.concatenate([beta, after[:, beta.shape[1] : n]], 1)
            follow = p[:, here] * beta
            g = np.multiply(alpha[:, here], beta, out=alpha[:, here])
            whole = g.sum(0)
            g /= whole
            whole *= scale[here]
            if t:
                last = alpha[:, begin[t - 1] : begin[t - 1] + n]
                joint += (last / whole) @ follow.T
                beta = self.step @ follow
                beta /= beta.sum(0)
            else:
                self.s += g[:, ~later].sum(1)
                joint += (before[:, later] / whole[later]) @ follow[:, later].T
        self.m += self.move * joint
        symbols = sym[place]
        for s in range(len(self.e)):
            self.e[s] += np.bincount(symbols, alpha[s], self.e.shape[1])
        return place, alpha

    def rows(self) -> Iterator[pa.RecordBatch]:
        for kind, rows in ((SYMBOL, self.e.T), (MOVE, self.m), (START, self.s[None]), (LIKELY, self.likely[None])):
            yield _sums(kind, np.arange(len(rows)), rows)


def _expect(start, move, emit, lookup: Lookup, shares: Shares | None = None):
    """Partition function: expected counts of Baum-Welch, a row for each symbol, state or word (kind, word, c and parts of it, n).

    Without ``shares`` a word's share of its class is the same in all states, and makes no difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(start, move, emit.shape[1])
        table = emit.astype(np.float32)
        sizes = {TAIL: 0, HELD: 0}
        kept: dict[int, list] = {TAIL: [], HELD: []}

        def out(kind):
            got, kept[kind], sizes[kind] = kept[kind], [], 0
            return _tail_sums(kind, *(_merged if kind == TAIL else _added)(got))

        for b in batches:
            own_lookup, _, own = shares.of(b.column(1) if b.num_columns > 1 else None) if shares else (None, None, None)
            for _, lengths, h, rank in _sequences(b.column(0), lookup):
                sym = _symbols(h, rank)
                put = (lambda prob: shares.put(prob, h, rank, _near(own_lookup, h, rank), own)) if shares else None
                tokens, states = sums.add(lengths, sym, *_chances(table, sym, put))
                ranks = rank[tokens]
                tail, held = np.flatnonzero(ranks < 0), np.flatnonzero(ranks >= WORDS)
                if len(tail):
                    kept[TAIL].append((h[tokens[tail]], np.concatenate([states[:, tail].T, np.ones((len(tail), 1), np.float32)], 1)))
                if len(held):
                    kept[HELD].append((ranks[held], states[:, held]))
                for kind, more in ((TAIL, tail), (HELD, held)):
                    sizes[kind] += len(more)
                    if sizes[kind] >= BUFFER:
                        yield out(kind)
        for kind in kept:
            if kept[kind]:
                yield out(kind)
        yield from sums.rows()

    return run


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary for each row of its ``counts`` values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _coded(lookup: Lookup):
    """Partition function: each text (the last column) as its symbols, 16 bits each, the ranks of words without a symbol, or -1, and the hashes of words without a rank; then the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, lengths, h, rank in _sequences(b.column(b.num_columns - 1), lookup):
                sym, text = _symbols(h, rank), np.repeat(np.arange(len(lengths)), lengths)
                tail, rest = sym >= WORDS, rank < 0
                count = lambda x: np.bincount(text[x], minlength=len(lengths))
                cols = [_binary(sym.astype(np.uint16), lengths), _binary(rank[tail].astype(np.int32), count(tail)), _binary(h[rest], count(rest))]
                others = [b.column(i).slice(first, len(lengths)) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, *others], names=["sym", "tail", "rest", *b.schema.names[:-1]])

    return run


def _parts(lengths: np.ndarray) -> list[np.ndarray]:
    """Rows of coded texts that are worked on at once."""
    done = np.cumsum(lengths, dtype=np.int64)
    return [x for x in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(done // TOGETHER)) + 1) if len(x)]


def _flat(column: pa.Array, part: np.ndarray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.slice(part[0], len(part)).to_pylist()), kind)


def _decoded(texts: pa.StructArray, known: Known):
    """``_sequences`` of texts from ``_coded``."""
    columns = [texts.field(i) for i in range(3)]
    lengths = pc.binary_length(columns[0]).to_numpy().astype(np.int64) // 2
    for part in _parts(lengths):
        sym, own, rest = (_flat(c, part, kind) for c, kind in zip(columns, (np.uint16, np.int32, np.uint64)))
        rank, h = sym.astype(np.int32), np.zeros(len(sym), np.uint64)
        tail = np.flatnonzero(rank >= WORDS)
        rank[tail] = own
        have = own >= 0
        h[tail[have]], h[tail[~have]] = known.words[own[have]], rest
        yield int(part[0]), lengths[part], h, rank


def _expect_coded(start, move, emit):
    """Partition function: ``_expect`` of symbols alone, from the texts of ``_coded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(start, move, emit.shape[1])
        table = emit.astype(np.float32)
        for b in batches:
            lengths = pc.binary_length(b.column(0)).to_numpy().astype(np.int64) // 2
            for part in _parts(lengths):
                sym = _flat(b.column(0), part, np.uint16).astype(np.int32)
                sums.add(lengths[part], sym, *_chances(table, sym))
        yield from sums.rows()

    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = [np.unique(np.frombuffer(x, np.uint16), return_counts=True) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i].astype(np.int32) for x in bags], pa.list_(pa.int32())) for i in range(2)], names=["sym", "n"])


def _seeded(coded: DataFrame, share: np.ndarray) -> np.ndarray:
    """First emissions: texts of a bounded sample around seeds that lie far apart."""
    ids = coded.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEEDS)
    some = coded.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(SEEDS)
    got = some.select("sym").mapInArrow(_bags, "sym array<int>, n array<int>").toArrow().to_pylist()
    got = sorted((r["sym"], r["n"]) for r in got)
    bags = np.zeros((len(got), len(share)), np.float32)
    for x, (sym, n) in zip(bags, got):
        x[sym] = n
    emit = np.tile(share, (STATES, 1))
    if len(bags):
        unit = np.log1p(bags) * np.log(1 / np.maximum(share, 1e-12)).astype(np.float32)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        pick = [int(np.argmax(bags.sum(1)))]
        while len(pick) < STATES:
            pick.append(int(np.argmin((unit @ unit[pick].T).max(1))))
        centre = unit[pick]
        for _ in range(8):
            near = np.argmax(unit @ centre.T, axis=1)
            for s in range(STATES):
                if (near == s).any():
                    c = unit[near == s].sum(0)
                    centre[s] = c / np.linalg.norm(c)
        for s in range(STATES):
            own = bags[near == s].sum(0) + 200.0 * share
            emit[s] = own / own.sum()
    return emit


def _next(sums: dict, emit_prior: np.ndarray):
    e = sums["e"] + 20.0 * emit_prior
    m = sums["m"] + 0.1 + np.eye(STATES)
    s = sums["s"] + 1.0
    return s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)


def _others(lookup: Lookup | Known):
    """Partition function: the distinct words of each text that are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, lengths, h, rank in _sequences(b.column(1), lookup):
                rest = np.flatnonzero(rank < 0)
                text = np.repeat(np.arange(len(lengths)), lengths)[rest]
                order = np.lexsort((h[rest], text))
                text, word = text[order], h[rest][order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
                key = b.column(0).to_numpy(zero_copy_only=False)[first + text[new]]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(word[new].view(np.int64))], names=["key", "word"])

    return run


def _scores(start, move, emit, lookup: Lookup, shares: Shares, base_log: np.ndarray, known: np.ndarray, z: float):
    """Partition function: each text's scores."""
    log10 = np.log(10.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, table = np.ascontiguousarray(move.T, np.float32), emit.astype(np.float32)
        for b in batches:
            own_lookup, own_c, own = shares.of(b.column(2) if b.num_columns > 2 else None)
            for first, lengths, h, rank in _sequences(b.column(1), lookup):
                near = _near(own_lookup, h, rank)
                prob, logs = _chances(table, _symbols(h, rank), lambda prob: shares.put(prob, h, rank, near, own))
                per = -(-lengths // RUN)
                text, no, at, size = _runs(lengths, RUN)
                before, _ = _edges(start, move, prob, per, text, no, at, size, back=False)
                order = np.argsort(-size, kind="stable")
                live, spot = _laid(size[order])
                place, p = _by_step(prob, at[order], live, spot)
                scale = np.empty(len(h), np.float32)
                a = np.where(no[order] > 0, turn @ before[order].T.astype(np.float32), start.astype(np.float32)[:, None])
                for t, n in enumerate(live.tolist()):
                    here = slice(spot[t], spot[t + 1])
                    a = (turn @ a[:, :n] if t else a) * p[:, here]
                    a.sum(0, out=scale[here])
                    a /= scale[here]
                logs[place] += np.log(scale, dtype=np.float64)
                total = np.add.reduceat(logs, np.cumsum(lengths) - lengths)
                begin = np.cumsum(lengths) - lengths
                have, met = rank >= 0, near >= 0
                base = np.where(have, base_log[rank], np.log10((np.where(met, own_c[near], 0) + SMOOTH) / z))
                n_known = np.add.reduceat(((have & known[rank]) | met).astype(np.int64), begin)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(lengths)), pa.array(lengths), pa.array(n_known), pa.array(np.add.reduceat(base, begin)), pa.array(total / log10)],
                    names=["doc_id", "n_tokens", "n_known", "base", "model"],
                )

    return run


def query(docs: DataFrame, fold: int = 1, most: int = KNOWN) -> DataFrame:
    """Scores of every text by the model and by single words, learnt outside the held-out fold."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = d.where(_training(fold))
    counts = stored(train.select("text").mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n_texts = train.count()
    ends = int(np.array([END]).view(np.int64)[0])
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, vocab = int(size[0]) + n_texts, int(size[1]) + (n_texts > 0)
    # the least count of which at most ``most`` words are left
    steps = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most).collect()
    left, least = most, 1 << 62
    for r in steps:
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    top = counts.where(F.col("c") >= least).select("word", "c").toArrow() if least < 1 << 62 else None
    word = top.column("word").to_numpy() if top else np.zeros(0, np.int64)
    c = top.column("c").to_numpy() if top else np.zeros(0, np.int64)
    word, c = np.append(word, ends), np.append(c, n_texts)
    order = np.lexsort((word, -c))
    order = np.concatenate([order[word[order] == ends], order[word[order] != ends]])  # the end token has a symbol of its own
    word, c = word[order], c[order].astype(float)
    # classes of the words without a symbol
    kind = F.col("word").bitwiseAND(F.lit(255))
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n_class[r["k"]], v_class[r["k"]] = r["n"], r["v"]
    np.subtract.at(n_class, word[1:WORDS] & 255, c[1:WORDS])
    np.subtract.at(v_class, word[1:WORDS] & 255, 1)
    whole = n_class + SMOOTH * (v_class + 1)
    share = np.zeros(WORDS + CLASSES)
    share[: min(WORDS, len(c))] = c[:WORDS]
    share[WORDS:] = whole
    share /= share.sum()

    start, move = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.04 / (STATES - 1)) + np.eye(STATES) * (0.96 - 0.04 / (STATES - 1))
    hashes = word.astype(np.int64).view(np.uint64)
    held_words = Known(hashes)
    # all later steps read and move these codes; words are looked up here alone
    id_type = docs.schema["doc_id"].dataType.simpleString()
    coded = stored(d.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(tidy(_coded(Lookup(hashes, np.arange(len(word), dtype=np.int32)))), f"sym binary, tail binary, rest binary, doc_id {id_type}, key long"))
    text = F.struct("sym", "tail", "rest").alias("text")
    d, symbols = coded.select("doc_id", "key", text), coded.where(_training(fold)).select("sym")
    train = d.where(_training(fold))
    emit = _seeded(coded.where(_training(fold)), share)
    # texts alike in id and words are taken together
    warm = stored(coded.where(_training(fold) & (F.pmod("key", F.lit(max(1, n_texts // WARM))) == 0)).select("sym").repartition(24))
    released(docs.sparkSession)
    # a text's words that are not held, if training has any such words
    others = stored(d.select("key", "text").mapInArrow(_others(held_words), "key long, word long")) if least > 1 else None

    def joined(texts: DataFrame, rest: DataFrame, *cols: str) -> DataFrame:
        """cols of texts, and as ``met`` the expected counts of their words that are not held."""
        if others is None:
            return texts.select(*cols)
        met = others.join(rest, "word").groupBy("key").agg(F.collect_list(F.struct("word", "c", *_PARTS)).alias("met"))
        return texts.select(*cols, "key").join(met, "key", "left").select(*cols, "met")

    def round_of(model, texts: DataFrame, keep: bool = False):
        """The sums of a round over texts, its log likelihood a token, and with ``keep`` the table of all sums."""
        found = _summed(texts.mapInArrow(tidy(model), "kind byte, word long, c long, a long, b long, n array<double>"))
        found = stored(found) if keep else found
        sums = {"e": np.zeros((STATES, WORDS + CLASSES)), "m": np.zeros((STATES, STATES)), "s": np.zeros(STATES)}
        likely = 0.0
        for r in found.where(~F.col("kind").isin(TAIL, HELD)).select("kind", "word", "n").toArrow().to_pylist():
            n = r["n"]
            if r["kind"] == SYMBOL:
                sums["e"][:, r["word"]] = n
            elif r["kind"] == MOVE:
                sums["m"][r["word"]] = n
            elif r["kind"] == LIKELY:
                likely = n[0] / max(n[1], 1.0)
            else:
                sums["s"] += n
        return sums, likely, found if keep else None

    # first the symbols' model, a word telling its state by its symbol alone: on some texts, to begin nearer, until it gains less than GAIN, then on all until it gains little
    for texts, little in ((warm, GAIN), (symbols, NEAR if n_texts >= 2 * WARM else GAIN)):
        was = -np.inf
        for _ in range(ROUNDS):
            sums, likely, _ = round_of(_expect_coded(start, move, emit), texts)
            if texts is warm and not sums["e"].any():  # no text was taken
                break
            start, move, emit = _next(sums, share)
            gain, was = likely - was, likely
            if gain < little:
                break

    # then rounds that sum words too; the first is one of symbols still, and comes again if those were near their end only; the scores of a round's model tell what the round gained
    z = n_all + SMOOTH * (vocab + 1)
    base_log = np.log10((c + SMOOTH) / z)
    schema = f"doc_id {id_type}, n_tokens long, n_known long, base double, model double"
    shares, texts, ready = None, train.select("text"), gain < GAIN
    done = 0  # rounds since the symbols' model was ready
    for _ in range(ROUNDS):
        sums, likely, found = round_of(_expect(start, move, emit, held_words, shares), texts, keep=True)
        start, move, emit = _next(sums, share)
        gain, was = likely - was, likely
        ready = ready or gain < GAIN
        if not ready:
            continue
        ratio = _ratio(sums["e"], n_class)
        held = np.ones((max(len(word) - WORDS, 0), STATES), np.float32)
        for got in found.where(F.col("kind") == HELD).select("word", "c", *_PARTS).toArrow().to_batches(1 << 16):
            rank, own = got.column(0).to_numpy(), got.column(1).to_numpy()
            held[rank - WORDS] = _per_state(_unpacked(pa.Table.from_batches([got]), own), own, word[rank], ratio, whole)
        shares, rest = Shares(held, ratio, whole), found.where(F.col("kind") == TAIL).select("word", "c", *_PARTS)
        # the words that no worker holds join once the others have shares
        texts = joined(train, rest, "text") if done else texts
        released(docs.sparkSession)
        done += 1
        if done < 3:  # not all words' shares took part, if some are not held, so the likelihood is no measure for the next round's
            continue
        model = _scores(start, move, emit, held_words, shares, base_log, c > 0, z)
        scored = stored(joined(d, rest, "doc_id", "text").mapInArrow(tidy(model), schema))
        own = scored.where(_training(fold)).agg(F.sum("model"), F.sum("n_tokens")).first()
        if (own[0] or 0.0) * np.log(10.0) / max(own[1] or 0, 1) - likely < GAIN:
            break

    return scored.select(
        "doc_id", (~_training(fold)).alias("held_out"), "n_tokens", "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"),
    )

"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct words and their first letters; an identity
term is one feature of its own, always part of the model, and has no first
letters.  Logistic regression over the features that tell the classes apart
best is trained on at most ``SAMPLE`` labelled documents of each class
(smallest hashed ids, then texts), with a penalty on the mean squared change of
the logit over counterfactuals of all labelled sentences, of both classes: each
term that a sentence names is swapped for each other term; a sentence that
names none gets each term put in, swapped for each other; and in a non-toxic
sentence naming a group is held against not naming it.  So naming a group is no
evidence by itself.

A swap changes only features of terms, so the sum of all counterfactuals'
squared changes is a form in the terms' weights alone: workers add up its
matrix (terms x terms), and no sentence has to be left out.

Defined cases: a null text counts as empty and scores as the intercept alone;
without labels of both classes every score is the share of toxic labels seen
(near 0 without any); a document with both labels counts for each; rows repeat
as they come; a long text is scored whole; other columns are ignored; an empty
table gives an empty result.
Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import durable, free_name, tidy

#: Labelled documents of each class that are trained on, at most.
SAMPLE = 4000
#: Features besides the identity terms.
FEATURES = 2048
STEMS = (3, 4, 5, 6)
THRESHOLD = 0.3
SWAP_PENALTY = 100.0
RIDGE = 1e-4

# Identity terms that may be swapped for one another.
IDENTITY = (
    "muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "black", "white", "asian", "latino", "african", "european",
    "gay", "lesbian", "straight", "transgender", "women", "men", "immigrants", "natives", "disabled", "elderly",
    "musulman", "juif", "femmes", "hommes", "muslime", "juden", "frauen", "männer", "musulmanes", "judíos", "mujeres", "hombres",
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_TERMS = frozenset(IDENTITY)


def features(text: str) -> set[str]:
    """Identity terms as ``@term``, other words as ``=word`` and their first letters as they are."""
    words = set(_WORD.findall(text.lower()))
    out = {"@" + w for w in words & _TERMS}
    words -= _TERMS
    out.update(["=" + w for w in words])
    for n in STEMS:
        out.update([w[:n] for w in words if len(w) >= n])
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 100):
            part = b.slice(k, 100)
            sets = [list(features(t or "")) for t in part.column(1).to_pylist()]
            label = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(label), pa.array([f for s in sets for f in s], pa.string())], names=["toxic", "feature"])


def _sample(docs: DataFrame, labels: DataFrame, fold: int) -> tuple[DataFrame, dict[int, int]]:
    """toxic and text of at most ``SAMPLE`` rows of each class, and how many labels each class has in all."""
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    lab = lab.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != fold).distinct()
    sizes = {r[0]: r[1] for r in lab.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    out = []
    for k in (0, 1):
        ids = lab.where(F.col("toxic") == k).orderBy(*order).limit(SAMPLE)
        # an id may stand on any number of rows, so the rows are bounded too
        out.append(docs.select("doc_id", "text").join(ids, "doc_id").orderBy(*order, F.xxhash64("text")).limit(SAMPLE))
    return durable(out[0].unionAll(out[1]).select("toxic", "text")), sizes


def swap_sums(texts: list[tuple[int, str]]) -> tuple[np.ndarray, int]:
    """The matrix of the counterfactuals' summed squared changes, and how many there are, for labelled texts."""
    k, at = len(IDENTITY), {t: i for i, t in enumerate(IDENTITY)}
    gram, n, plain = np.zeros((k, k)), 0, [0, 0]
    for toxic, text in texts:
        for sentence in _SENTENCE.split(text.lower()):
            words = _WORD.findall(sentence)
            if not words:
                continue
            named = sorted({at[w] for w in words if w in at})
            if not named:
                plain[toxic] += 1
                continue
            absent = np.ones(k)
            absent[named] = 0
            for i in named:  # swapped for each other term; for one that is there already it only goes
                gram[i, i] += k - 1
                gram[i] -= absent
                gram[:, i] -= absent
                gram[np.diag_indices(k)] += absent
                n += k - 1
                if not toxic:
                    gram[i, i] += 1
                    n += 1
    gram += sum(plain) * (k * np.eye(k) - 1) + plain[0] * np.eye(k)
    return gram, n + sum(plain) * k * (k - 1) // 2 + plain[0] * k


def _swap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            gram, n = swap_sums([(y, t or "") for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])
            at = np.append(np.flatnonzero(gram), gram.size)  # the last row has the number of counterfactuals
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(gram.ravel(), n)[at].astype(float))], names=["at", "v"])


def train(docs: DataFrame, labels: DataFrame, fold: int = 2, penalty: float = SWAP_PENALTY) -> tuple[float, dict[str, float]]:
    """Intercept and feature weights, from labelled rows outside the held-out fold."""
    sample, sizes = _sample(docs, labels, fold)
    got = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(got) < 2:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        share = min(max(share, 1e-9), 1 - 1e-9)
        return float(np.log(share / (1 - share))), {}
    p, q = got[1], got[0]
    seen = sample.mapInArrow(_explode, "toxic int, feature string").groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    seen = seen.where("p + q >= 5 and not startswith(feature, '@')")
    gap = F.abs(F.col("p") / p - F.col("q") / q) / F.sqrt((F.col("p") + F.col("q") + 2.0) / (p + q))
    names = ["@" + t for t in IDENTITY] + [r[0] for r in seen.orderBy(gap.desc(), "feature").limit(FEATURES).collect()]
    spot = {f: k for k, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                hits = [sorted(spot[f] for f in features(t or "") if f in spot) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "hits"])

    # 2 * SAMPLE rows at most, of a number for each feature of the model that a text has; the sums have terms x terms rows
    got_rows = sample.mapInArrow(rows, "toxic int, hits array<int>").orderBy("toxic", "hits").toArrow()
    sums = sample.mapInArrow(_swap_rows, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    gram = np.zeros(len(IDENTITY) ** 2 + 1)
    gram[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    y = got_rows.column("toxic").to_numpy().astype(float)
    hits = got_rows.column("hits").to_pylist()
    lengths = [len(h) for h in hits]
    col = np.array([f for h in hits for f in h], np.int64)
    row = np.repeat(np.arange(len(y)), lengths)
    weight = np.where(y == 1, sizes[1] / p, sizes[0] / q)
    swaps = gram[:-1].reshape(len(IDENTITY), -1) * (penalty / max(1.0, gram[-1]))
    w, b = _fit(row, col, y, weight / weight.sum(), len(names), swaps)
    return b, {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6}


def _slope(w, b, row, col, y, weight, swaps):
    """Gradient of ``objective``."""
    z = np.bincount(row, w[col], len(y)) + b
    e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
    g = np.bincount(col, e[row], len(w)) + RIDGE * w
    g[: len(swaps)] += swaps @ w[: len(swaps)]
    return g, e.sum()


def objective(w, b, row, col, y, weight, swaps) -> float:
    """Weighted log loss, ridge and swap penalty, whose matrix ``swaps`` acts on the first weights."""
    z = np.bincount(row, w[col], len(y)) + b
    v = w[: len(swaps)]
    return float(weight @ (np.logaddexp(0, z) - y * z) + RIDGE * (w @ w) / 2 + v @ swaps @ v / 2)


def _fit(row, col, y, weight, n: int, swaps: np.ndarray, steps: int = 400):
    """Adam on the objective; deterministic."""
    w, b = np.zeros(n), float(np.log((weight @ y + 1e-9) / (weight @ (1 - y) + 1e-9)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = _slope(w, b, row, col, y, weight, swaps)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def score(docs: DataFrame, model: tuple[float, dict[str, float]], keep: str | list[str] = "doc_id", name: str = "score") -> DataFrame:
    """``keep`` and score, as ``name``, for every row; a model holds at most ``FEATURES`` weights and the terms'."""
    keep = [keep] if isinstance(keep, str) else keep
    base, weights = model
    words = {f[1:]: x for f, x in weights.items() if f[0] in "=@"}
    stems = [(n, {f: x for f, x in weights.items() if f[0] not in "=@" and len(f) == n}) for n in STEMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part, z = b.slice(k, 200), []
                for t in part.column(len(keep)).to_pylist():
                    seen = set(_WORD.findall((t or "").lower()))
                    # sums over sorted features: the same whatever order a set has
                    x = [words[w] for w in sorted(seen & words.keys())]
                    seen -= _TERMS
                    for n, s in stems:
                        x += [s[f] for f in sorted({w[:n] for w in seen if len(w) >= n} & s.keys())]
                    z.append(base + sum(x))
                out = 1 / (1 + np.exp(-np.clip(np.array(z), -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(out)], names=[*keep, name])

    return docs.select(*keep, "text").mapInArrow(tidy(run), StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, train(docs, labels))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text is not predicted toxic, whatever their id."""
    name = free_name(docs, "score")
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) < THRESHOLD).drop(name)

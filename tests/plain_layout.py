"""Layout detection of one sheet with arrays, as a plain version to test against."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from larkspur.operators.reshape import TOTALS

KINDS = ("", "TEXT", "NUM", "DATE", "BOOL")
EMPTY, TEXT, NUM, DATE, BOOL = range(5)
# Weights of a header's score, and the scores that count.
WEIGHTS = {"text": 0.34, "differs": 0.28, "styled": 0.16, "unique": 0.10, "dense": 0.12}
HEADER, SECOND_HEADER, STACKED_HEADER, ABOVE_STACKED = 0.45, 0.62, 0.70, 0.55
HEADER_ROWS, BODY_ROWS, DEEPEST = 4, 8, 10
# Confidences of blocks, and what shares of fitting cells add to them.
FRAGMENT, BANNER, PAIRS, CROSSTAB, TABLE, SURE = 0.3, 0.9, (0.75, 0.2), (0.6, 0.3), 0.15, 0.99


@dataclass
class Block:
    r0: int
    r1: int
    c0: int
    c1: int
    kind: str = "fragment"
    confidence: float = FRAGMENT
    body: int = 0
    head: int = 0  # rows of the header
    header: list = field(default_factory=list)
    context: dict = field(default_factory=dict)
    totals: int | None = None

    @property
    def height(self) -> int:
        return self.r1 - self.r0 + 1

    @property
    def width(self) -> int:
        return self.c1 - self.c0 + 1

    def beside(self, other: Block) -> bool:
        return self.c1 < other.c0 or other.c1 < self.c0


class Sheet:
    """A sheet's probe as arrays."""

    def __init__(self, cells: pd.DataFrame):
        n, m = int(cells["row"].max()) + 1, int(cells["col"].max()) + 1
        at = cells["row"].to_numpy(), cells["col"].to_numpy()
        self.kind, self.styled = np.zeros((n, m), np.int8), np.zeros((n, m), bool)
        self.text, self.wide = np.full((n, m), None, object), np.zeros(n, bool)
        self.kind[at] = cells["kind"].map(KINDS.index).to_numpy()
        self.styled[at], self.text[at] = cells["styled"].to_numpy(), cells["raw"].to_numpy()
        self.wide[cells.loc[cells["wide"], "row"].to_numpy()] = True

    def usual(self, first: int, b: Block) -> np.ndarray:
        """The commonest kind of each column in the first rows of a body; of equally common ones, the first seen."""
        part = self.kind[first : min(b.r1, first + BODY_ROWS) + 1, b.c0 : b.c1 + 1]
        out = np.zeros(b.width, np.int8)
        for k in range(b.width if len(part) else 0):
            seen = part[part[:, k] > 0, k]
            if len(seen):
                kinds, at, n = np.unique(seen, return_index=True, return_counts=True)
                out[k] = kinds[np.lexsort((at, -n))[0]]
        return out

    def score(self, r: int, b: Block) -> float:
        """How much row ``r`` looks like the header of what is below it."""
        kinds = self.kind[r, b.c0 : b.c1 + 1]
        full = kinds > 0
        if not full.any():
            return 0.0
        usual = self.usual(r + 1, b)
        labels = [str(x).strip() for x in self.text[r, b.c0 : b.c1 + 1][full]]
        parts = {
            "text": (kinds == TEXT).sum() / full.sum(),
            "differs": (full & (usual > 0) & (usual != kinds)).mean(),
            "styled": self.styled[r, b.c0 : b.c1 + 1].any(),
            "unique": len(set(labels)) / len(labels),
            "dense": full.mean(),
        }
        return float(sum(WEIGHTS[k] * v for k, v in parts.items()))


def _shrink(full: np.ndarray, b: Block) -> Block | None:
    rows, cols = np.nonzero(full[b.r0 : b.r1 + 1, b.c0 : b.c1 + 1])
    return Block(b.r0 + int(rows.min()), b.r0 + int(rows.max()), b.c0 + int(cols.min()), b.c0 + int(cols.max())) if len(rows) else None


def _spans(line: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def _cut(full: np.ndarray) -> list[Block]:
    """Regions between blank rows and columns: every cut goes through all gaps of the axis that has the widest."""
    todo, done = [(Block(0, full.shape[0] - 1, 0, full.shape[1] - 1), 0)], []
    while todo:
        b, depth = todo.pop()
        b = _shrink(full, b)
        if b is None:
            continue
        part = full[b.r0 : b.r1 + 1, b.c0 : b.c1 + 1]
        lines = part.any(axis=1), part.any(axis=0)
        gap = [max((y - x for x, y in _spans(~a)), default=0) for a in lines]
        if depth == DEEPEST or not max(gap):
            done.append(b)
        elif gap[0] >= gap[1]:
            todo += [(Block(b.r0 + x, b.r0 + y - 1, b.c0, b.c1), depth + 1) for x, y in _spans(lines[0])]
        else:
            todo += [(Block(b.r0, b.r1, b.c0 + x, b.c0 + y - 1), depth + 1) for x, y in _spans(lines[1])]
    return done


def _islands(full: np.ndarray, b: Block) -> list[Block]:
    """Parts of a region that no chain of neighbours joins, once every cell has grown by one to its four sides.

    Runs of each row are nodes; runs that touch those of the row above are joined.
    """
    own = full[b.r0 : b.r1 + 1, b.c0 : b.c1 + 1]
    p = np.pad(own, 1)
    grown = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    parent: list[int] = []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    runs, above = [], []
    for r in range(len(grown)):
        here = []
        for x, y in _spans(grown[r]):
            me = len(parent)
            parent.append(me)
            here.append((x, y, me))
            runs.append((r, x, y))
            for u, v, other in above:
                if x <= v and u <= y:
                    parent[top(other)] = top(me)
        above = here
    box: dict[int, list[int]] = {}
    for me, (r, x, y) in enumerate(runs):
        cols = np.flatnonzero(own[r, x:y])
        if len(cols):
            a = [r, r, x + int(cols[0]), x + int(cols[-1])]
            o = box.setdefault(top(me), a)
            box[top(me)] = [min(o[0], a[0]), max(o[1], a[1]), min(o[2], a[2]), max(o[3], a[3])]
    return [Block(b.r0 + x[0], b.r0 + x[1], b.c0 + x[2], b.c0 + x[3]) for x in box.values()]


def _unstack(s: Sheet, b: Block) -> list[Block]:
    """Cuts above each row inside a block that is clearly a header while the row before it isn't."""
    if b.height < 6:
        return [b]
    starts = [b.r0] + [r for r in range(b.r0 + 2, b.r1 - 1) if s.score(r, b) >= STACKED_HEADER and s.score(r - 1, b) < ABOVE_STACKED]
    ends = [x - 1 for x in starts[1:]] + [b.r1]
    return [Block(x, y, b.c0, b.c1) for x, y in zip(starts, ends) if y > x]


def _header(s: Sheet, b: Block) -> tuple[range, float]:
    """Rows of a block's header, none, one or two, and the score of the first: the best of those at the top, the upper of equal ones."""
    top = np.array([s.score(r, b) for r in range(b.r0, min(b.r0 + HEADER_ROWS, b.r1))])
    if not len(top):
        return range(0), 0.0
    at = int(top.argmax()) if top.any() else 0
    first = b.r0 + at
    two = bool(top.any()) and first + 1 < b.r1 and s.score(first + 1, b) > SECOND_HEADER
    return range(first, first + 1 + two), float(top[at])


def _labels(s: Sheet, b: Block, rows: range) -> list[str]:
    """A label for each column: what its header cells say, a text twice only once, or else its place."""
    said = s.text[rows.start : rows.stop, b.c0 : b.c1 + 1]
    out = []
    for c, column in enumerate(said.T, b.c0):
        texts = pd.unique(pd.Series(column, dtype=object).dropna().astype(str).str.strip())
        out.append(" / ".join(texts) or f"col_{c}")
    return out


def _name(s: Sheet, b: Block) -> None:
    """Sets a block's kind."""
    kinds = s.kind[b.r0 : b.r1 + 1, b.c0 : b.c1 + 1]
    if b.height == 1 and b.width != 2:
        b.kind, b.confidence = "banner", BANNER
        return
    rows, score = _header(s, b)
    left = (kinds[:, 0] == TEXT).mean()
    if b.width == 2 and not s.styled[b.r0, b.c0 : b.c1 + 1].any():
        right = kinds[:, 1]
        # a long block whose values differ in kind in its first row alone has a header there
        values = right[1:] if b.height > BODY_ROWS else right
        mixed = len(set(values[values > 0].tolist())) > 1
        # names and texts without a header, few rows: pairs too, though all values are of one kind
        plain = b.height <= 3 and bool((right == TEXT).all())
        if left >= 0.8 and (right > 0).mean() >= 0.6 and (mixed or plain):
            b.kind, b.confidence = "key_value", PAIRS[0] + PAIRS[1] * float(left)
            return
    if b.height == 1:
        b.kind, b.confidence = "banner", BANNER
        return
    b.body, b.head, b.header = rows.stop if rows else b.r0, len(rows), _labels(s, b, rows)
    body = s.kind[b.body : b.r1 + 1, b.c0 : b.c1 + 1]
    if b.width >= 3 and b.height >= 3 and rows:
        heads, inner = set(s.kind[rows[0], b.c0 + 1 : b.c1 + 1].tolist()) - {EMPTY}, body[:, 1:]
        numeric = float((inner == NUM).sum() / max(1, (inner > 0).sum()))
        if heads and heads <= {DATE, NUM} and numeric >= 0.75 and (body[:, 0] == TEXT).mean() >= 0.7:
            b.kind, b.confidence = "crosstab", CROSSTAB[0] + CROSSTAB[1] * numeric
    if b.kind == "fragment" and b.height >= 3 and b.width >= 2 and score >= HEADER:
        b.kind, b.confidence = "table", min(SURE, score + TABLE)
    if b.kind in ("table", "crosstab"):
        marks = [r for r in range(b.body, b.r1 + 1) if any(re.match(TOTALS, str(x).lower()) for x in s.text[r, b.c0 : min(b.c0 + 2, b.c1 + 1)] if x is not None)]
        b.totals = max(marks, default=None)


def _says(s: Sheet, b: Block) -> dict[str, str]:
    if b.kind == "banner":
        first = next((str(x).strip() for x in s.text[b.r0, b.c0 : b.c1 + 1] if x is not None), "")
        return {"_section": first} if first else {}
    pairs = ((s.text[r, b.c0], s.text[r, b.c1]) for r in range(b.r0, b.r1 + 1))
    return {re.sub(r"\s+", "_", str(k).strip().rstrip(":").lower()): str(v) for k, v in pairs if k and str(k).strip() and v is not None}


def _around(s: Sheet, blocks: list[Block]) -> None:
    """A table's context: what stands over the first table, and over it what stands between it and the table before it."""
    tables = [b for b in blocks if b.kind in ("table", "crosstab")]
    donors = sorted((b for b in blocks if b.kind in ("banner", "key_value")), key=lambda b: b.r1)
    top = min((t.r0 for t in tables), default=0)
    for t in tables:
        wall = max((o.r1 for o in tables if o.r1 < t.r0 and not o.beside(t)), default=-1)
        near = [d for d in donors if top <= d.r1 < t.r0 and d.r1 > wall and not d.beside(t)]
        for d in [d for d in donors if d.r1 < top] + near:  # the later, the nearer
            t.context.update(_says(s, d))


def segment(s: Sheet) -> list[Block]:
    full = s.kind > 0
    texts, n = (s.kind == TEXT).sum(axis=1), full.sum(axis=1)
    lone = (n > 0) & (texts == n) & ((n == 1) | s.wide)
    rest = full & ~lone[:, None]
    blocks = []
    for region in _cut(rest):
        for part in _islands(rest, region) if region.height > 3 and region.width > 3 else [region]:
            blocks += [x for p in _unstack(s, part) if (x := _shrink(rest, p))]
    for b in blocks:
        _name(s, b)
    for r in np.flatnonzero(lone).tolist():
        cols = np.flatnonzero(full[r])
        blocks.append(Block(r, r, int(cols[0]), int(cols[-1]), "banner", BANNER))
    blocks.sort(key=lambda b: (b.r0, b.c0))
    _around(s, blocks)
    return [b for b in blocks if b.kind != "fragment" or b.height * b.width > 4]


def plain_blocks(cells: pd.DataFrame) -> list[tuple]:
    """block, kind, r0, r1, c0, c1, body, head, header, context, totals, confidence."""
    return [(i, b.kind, b.r0, b.r1, b.c0, b.c1, b.body, b.head, list(b.header), dict(b.context), b.totals, round(float(b.confidence), 9)) for i, b in enumerate(segment(Sheet(cells)))]

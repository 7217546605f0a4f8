"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the tokenizer's pattern.  Within a piece every live position
holds the rank of the pair it forms with its live right neighbour; a segment
tree keeps the leftmost least rank at its root.  A merge takes the root, joins
the two tokens and makes point updates at the two neighbours and the position
that died, each in logarithmic time.  The trees of many pieces of like length
are rows of one array and take their next merge together; long pieces have a
tree of their own.

Defined cases: a null text counts as empty, with no ids and empty bytes; rows
repeat as they come; special tokens' strings are ordinary text; a long text is
encoded whole, piece by piece; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidy
from .textops import Lookup

#: Pieces kept with their ids by each worker; more than that and it starts anew.
MEMO = 300_000
#: Code points of text that are split at once.
CHUNK = 400_000
WIDEST = 64
NEVER = np.int64(1) << 40


class Coder:
    """Encodes and decodes by a table of ranks; travels to the workers as a broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.token[k] = t
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, made = [], []
        for t, k in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    made.append(k)
        self.joined = Lookup(np.array(pairs, np.uint64), np.array(made, np.int32))
        self.memo: dict[str, bytes] = {}
        self._ready = None

    def state(self) -> dict:
        """Plain values that make the same coder elsewhere."""
        return {"pattern": self.pattern, "token": self.token, "byte": self.byte, "keys": self.joined.keys, "values": self.joined.values}

    @classmethod
    def of(cls, state: dict) -> Coder:
        """The coder of a broadcast state; it stays there, so a worker's later tasks find its memo."""
        if "coder" not in state:
            c = cls.__new__(cls)
            c.pattern, c.token, c.byte = state["pattern"], state["token"], state["byte"]
            c.joined = Lookup.__new__(Lookup)
            c.joined.keys, c.joined.values = state["keys"], state["values"]
            c.joined.mask = np.uint64(len(c.joined.keys) - 1)
            c.memo, c._ready = {}, None
            state["coder"] = c
        return state["coder"]

    @classmethod
    def read(cls, path: str, pattern: str) -> Coder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.joined(((a << 32) | b).view(np.uint64)).astype(np.int64)
        return np.where((r < 0) | (a < 0) | (b < 0), NEVER, r)

    def _forest(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, a power of two, as 32-bit little-endian bytes."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        tok = np.full((n, width + 1), -1, np.int64)
        inside = np.arange(width)[None, :] < size[:, None]
        tok[:, :width][inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        nxt[:, width] = width
        prv = np.tile(np.arange(-1, width), (n, 1))
        place = width.bit_length()  # a key is rank and position, so the least is the leftmost of the least rank
        tree = np.full((n, 2 * width), NEVER << place, np.int64)
        first, second = tok[:, :width].ravel(), tok[:, 1 : width + 1].ravel()
        tree[:, width:] = (self._rank(first, second).reshape(n, width) << place) | np.arange(width)
        half = width
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])

        def put(rows: np.ndarray, pos: np.ndarray, rank: np.ndarray) -> None:
            node = pos + width
            tree[rows, node] = (rank << place) | pos
            while node[0] > 1 if len(node) else False:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(n)
        low = np.int64((1 << place) - 1)
        while True:
            root = tree[rows, 1]
            going = root < (NEVER << place)
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            p, rank = root & low, root >> place
            q = nxt[rows, p]
            after = nxt[rows, q]
            tok[rows, p], tok[rows, q] = rank, -1
            nxt[rows, p] = after
            prv[rows, after] = p
            put(rows, q, np.full(len(rows), NEVER))
            put(rows, p, self._rank(rank, tok[rows, after]))
            before = prv[rows, p]
            has = before >= 0
            if has.any():
                r, b = rows[has], before[has]
                put(r, b, self._rank(tok[r, b], rank[has]))
        live = tok[:, :width]
        ids = live[live >= 0].astype("<u4").tobytes()
        ends = np.cumsum((live >= 0).sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _alone(self, piece: bytes) -> bytes:
        """A long piece, with a tree of its own."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        tok = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self._rank(tok[:-1], tok[1:])
        leaf = np.full(2 * width, NEVER, np.int64)
        leaf[width : width + n - 1] = rank
        half = width
        while half > 1:
            half //= 2
            leaf[half : 2 * half] = np.minimum(leaf[2 * half : 4 * half : 2], leaf[2 * half + 1 : 4 * half : 2])
        tree, tok, never = leaf.tolist(), tok.tolist(), int(NEVER)
        pair = self._pairs()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a <= b else b
                if tree[i] == value:
                    return
                tree[i] = value

        while tree[1] < never:
            best, i = tree[1], 1
            while i < width:  # the left child first: leftmost of the least
                i = 2 * i if tree[2 * i] == best else 2 * i + 1
            p = i - width
            q = nxt[p]
            after = nxt[q]
            tok[p], tok[q] = best, -1
            nxt[p] = after
            put(q, never)
            if after < n:
                prv[after] = p
                put(p, pair.get((best << 32) | tok[after], never))
            else:
                put(p, never)
            if prv[p] >= 0:
                b = prv[p]
                put(b, pair.get((tok[b] << 32) | best, never))
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def _setup(self):
        if self._ready is None:
            full = regex.compile(self.pattern)
            # The letters, numbers and white space among the first 256 code points.
            letter, number, blank = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
            p = self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
            fast = re.compile(p.replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]"))
            self._ready = fast.findall, full.findall, {}
        return self._ready

    def _pairs(self) -> dict:
        made = self._setup()[2]
        if not made:
            used = self.joined.values >= 0
            made.update(zip(self.joined.keys[used].tolist(), self.joined.values[used].tolist()))
        return made

    def pieces(self, text: str) -> list[str]:
        fast, full, _ = self._setup()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return fast(text)

    def _learn(self, new: set[str]) -> None:
        groups: dict[int, list[str]] = {}
        for p in new:
            n = len(p.encode())
            if n > WIDEST:
                self.memo[p] = self._alone(p.encode())
            else:
                groups.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(p)
        for width, ps in groups.items():
            for k in range(0, len(ps), 20_000):
                part = ps[k : k + 20_000]
                self.memo.update(zip(part, self._forest([p.encode() for p in part], width)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit little-endian bytes."""
        out: list[bytes] = []
        first = 0
        while first < len(texts):
            last, n = first, 0
            while last < len(texts) and (last == first or n + len(texts[last]) <= CHUNK):
                n += len(texts[last])
                last += 1
            cut = [self.pieces(t) for t in texts[first:last]]
            new = set().union(*cut)
            if len(self.memo) + len(new) > MEMO:
                self.memo = {p: self.memo[p] for p in new if p in self.memo}
            self._learn(new - self.memo.keys())
            get = self.memo.__getitem__
            out += [b"".join(map(get, c)) for c in cut]
            first = last
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(spark, path: str | None):
    import public_tokenizers

    return spark.sparkContext.broadcast(Coder.read(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).state())


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for k in range(0, len(texts), 200):
        yield k, [t or "" for t in texts.slice(k, 200).to_pylist()]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids``, the token ids of each whole text."""
    coder = _coder(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, texts in _parts(b.column(1)):
                ids = Coder.of(coder.value).encode(texts)
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(texts)), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``bytes``, what the ids stand for."""
    coder = _coder(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                out = [Coder.of(coder.value).decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Digests of each text's ids and of the bytes they decode to, and the ids themselves if asked for."""
    coder = _coder(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = Coder.of(coder.value), hashlib.sha256
        for b in batches:
            for k, texts in _parts(b.column(1)):
                ids = c.encode(texts)
                sizes = [len(x) // 4 for x in ids]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                out = [b.column(0).slice(k, len(texts)), pa.array(sizes, pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array([sha(c.decode(x)).hexdigest() for x in ids], pa.string())]
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    out.append(pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema + ", ids array<int>" * with_ids)


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return digests(docs, path)

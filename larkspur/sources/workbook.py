"""Cells of workbooks (.xlsx) and of .csv and .tsv files as one table.

Files come through Spark's own readers, so any store that Spark reads will do.
Text files are read in splits by any number of tasks.  A workbook is unzipped
where it lies by one task, which cuts its sheets into pieces of whole rows;
these are dealt out and parsed by any number of tasks.  A cell's kind is TEXT,
NUM, DATE or BOOL; blank cells have no row.  The cells under a merged range take
the kind of its first cell, with no value.
"""

from __future__ import annotations

import csv
import datetime as dt
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestFailed

SCHEMA = "path string, sheet string, row int, col int, raw string, kind string, styled boolean, wide boolean"
TYPES = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("raw", pa.string()), ("kind", pa.string()), ("styled", pa.bool_()), ("wide", pa.bool_())])
SUFFIXES = (".xlsx", ".xlsm", ".csv", ".tsv")
#: Rows to an Arrow batch.
BATCH = 20_000
#: Bytes of a sheet's XML to a piece, and of those read at once.
PIECE, READ = 4 << 20, 1 << 20
PIECES = pa.schema([
    ("path", pa.string()), ("sheet", pa.string()), ("first", pa.int32()), ("before", pa.int32()), ("xml", pa.binary()),
    ("merged", pa.list_(pa.int32())), ("used", pa.list_(pa.int32())), ("shared", pa.list_(pa.string())), ("styles", pa.list_(pa.int32())),
])
SPLITS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n0", pa.int64()), ("open0", pa.bool_()), ("n1", pa.int64()), ("open1", pa.bool_())])
PARTS = pa.schema([("path", pa.string()), ("row", pa.int32()), ("start", pa.int64()), ("text", pa.string())])
_QUOTED = re.compile(r'(?:[^"]|"")*')
#: Rows and columns that layout detection looks at.
PROBE_ROWS, PROBE_COLS = 2000, 512

NUMERIC = re.compile(r"\(?[+-]?[₹$€£¥]?\s*(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*%?\)?")
ISO_DATE = re.compile(r"\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d)?)?")
# Number formats that the file format defines as dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_EPOCH = dt.datetime(1899, 12, 30)


def kind_of(text: str) -> str:
    t = text.strip()
    return "NUM" if NUMERIC.fullmatch(t) else "DATE" if ISO_DATE.fullmatch(t) else "TEXT"


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _all_text(e) -> str:
    """A string item's text, without phonetic hints."""
    return "".join(t.text or "" for r in e if _tag(r) in ("t", "r") for t in ([r] if _tag(r) == "t" else [x for x in r if _tag(x) == "t"]))


def _styles(z: zipfile.ZipFile) -> list[tuple[bool, bool]]:
    """(styled, is a date) of each cell format."""
    if "xl/styles.xml" not in z.namelist():
        return []
    parts = {_tag(e): e for e in ET.fromstring(z.read("xl/styles.xml"))}
    below = lambda name: list(parts[name]) if name in parts else []
    own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in below("numFmts")}
    bold = [any(_tag(x) == "b" and x.get("val", "1") not in ("0", "false") for x in e) for e in below("fonts")]
    solid = []
    for e in below("fills"):
        p = next((x for x in e if _tag(x) == "patternFill"), None)
        color = next((x.get("rgb") for x in p if _tag(x) == "fgColor"), "theme") if p is not None else None
        solid.append(p is not None and p.get("patternType") == "solid" and color not in ("00000000", "FFFFFFFF"))
    out = []
    for e in below("cellXfs"):
        n, font, fill = (int(e.get(k, 0)) for k in ("numFmtId", "fontId", "fillId"))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, ""))
        out.append(((font < len(bold) and bold[font]) or (fill < len(solid) and solid[fill]), n in DATE_FORMATS or bool(re.search("[ymdhs]", code.lower()))))
    return out


def _value(kind: str, raw: str | None, cell, shared: dict[int, str], date: bool) -> tuple[str, str] | None:
    """(text, kind) of a cell, or None for a blank one."""
    if kind == "inlineStr":
        item = next((x for x in cell if _tag(x) == "is"), None)
        raw = _all_text(item) if item is not None else None
    if raw is None or not raw.strip():
        return None
    if kind == "s":
        raw = shared[int(raw)]
    if kind in ("s", "str", "inlineStr", "e"):
        return (raw, kind_of(raw)) if raw.strip() else None
    if kind == "b":
        return ("true" if raw == "1" else "false"), "BOOL"
    if kind == "d":
        return raw, "DATE"
    if date:
        at = _EPOCH + dt.timedelta(days=float(raw))
        return (at.date().isoformat() if at.time() == dt.time() else at.isoformat(" ", "seconds")), "DATE"
    return raw, "NUM"


# A workbook: sheets are cut into pieces of whole rows, and pieces are parsed on their own.

_ROW = re.compile(rb"<(?:\w+:)?row\b([^>]*)>")
_ROW_NO = re.compile(rb'(?:^|\s)r="(\d+)"')
_ROW_END = re.compile(rb"</(?:\w+:)?row>")
_ROWS_END = re.compile(rb"</(?:\w+:)?sheetData>|<(?:\w+:)?sheetData\s*/>")
_MERGE = re.compile(rb'<(?:\w+:)?mergeCell\b[^>]*\bref="([^"]+)"')
_SHARED = re.compile(rb't="s"[^>]*>\s*<(?:\w+:)?v>(\d+)<')


def merges(z: zipfile.ZipFile, part: str) -> list[tuple[int, int, int, int]]:
    """Merged ranges (r0, r1, c0, c1); they stand behind the rows, none of which is kept."""
    tail, found = b"", False
    with z.open(part) as f:
        while chunk := f.read(READ):
            tail += chunk
            if not found:
                m = _ROWS_END.search(tail)
                found, tail = bool(m), tail[m.end() :] if m else tail[-64:]
    out = []
    for m in _MERGE.finditer(tail if found else b""):
        a, _, b = m[1].decode().partition(":")
        (r0, c0), (r1, c1) = _place(a), _place(b or a)
        out.append((r0, r1, c0, c1))
    return sorted(out)


def _cut(z: zipfile.ZipFile, part: str, rows: int | None) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    """head, piece, row before it, first and last row: a sheet's XML in pieces of whole rows, as far as row ``rows``."""
    head, held, row = None, b"", -1
    with z.open(part) as f:
        more = True
        while more:
            chunk = f.read(READ)
            more, held = bool(chunk), held + chunk
            if head is None:
                if not (m := _ROW.search(held)):
                    continue
                head, held = held[: m.start()], held[m.start() :]
            if more and len(held) < PIECE:
                continue
            ends = [m.end() for m in _ROW_END.finditer(held)]
            piece, held = (held, b"") if not more else (held[: ends[-1]], held[ends[-1] :]) if ends else (b"", held)
            before, first = row, None
            for m in _ROW.finditer(piece):
                row = int(n[1]) - 1 if (n := _ROW_NO.search(m[1])) else row + 1
                first = row if first is None else first
            if first is not None:
                yield head, piece, before, first, row
            if rows is not None and row >= rows:
                return


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of a workbook's sheets, and where their XML lies; none for another zip file."""
    if "xl/workbook.xml" not in z.namelist():
        return []
    to, out = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}, []
    for e in ET.fromstring(z.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet":
            target = to[next(v for k, v in e.attrib.items() if k.endswith("}id"))]
            out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    out = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ET.iterparse(f):
                if _tag(e) == "si":
                    out.append(_all_text(e))
                    e.clear()
    return out


def style_codes(z: zipfile.ZipFile) -> list[int]:
    """For each cell format 2 if it is styled, and 1 more if it is a date's."""
    return [2 * x + y for x, y in _styles(z)]


def pieces(z: zipfile.ZipFile, sheet: str, part: str, shared: list[str], styles: list[int], merged: list[tuple[int, int, int, int]], rows: int | None) -> Iterator[dict]:
    """A sheet's XML in pieces of whole rows, each with the merged ranges, shared strings and styles that it needs."""
    for head, piece, before, first, last in _cut(z, part, rows):
        used = sorted({int(m[1]) for m in _SHARED.finditer(piece)})
        low = max([last, *(r1 for r0, r1, _, _ in merged if first <= r0 <= last)])  # what a merged range covers may lie below the piece
        near = [m for m in merged if m[0] <= low and m[1] >= first]
        yield {"sheet": sheet, "first": first, "before": before, "xml": head + piece, "merged": [x for m in near for x in m], "used": used, "shared": [shared[i] for i in used], "styles": styles}


def _pieces(rows: int | None):
    """Stage one: a row for each piece of each sheet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = pa.BufferReader(content.as_buffer())
                if not zipfile.is_zipfile(data):  # no workbook: a file without cells
                    continue
                with zipfile.ZipFile(data) as z:
                    found = sheets(z)
                    shared, styles = (shared_strings(z), style_codes(z)) if found else ([], [])
                    for sheet, part in found:
                        for piece in pieces(z, sheet, part, shared, styles, merges(z, part), rows):
                            yield pa.RecordBatch.from_pylist([{"path": path} | piece], PIECES)

    return run


def cells_of(piece: dict, rows: int | None) -> Iterator[tuple]:
    """row, col, raw, kind, styled, wide of a piece."""
    flat = piece["merged"]
    merged = {(r0, c0): (r1, c1) for r0, r1, c0, c1 in zip(*[iter(flat)] * 4)}
    wide = {r for (r0, c0), (r1, c1) in merged.items() if c1 - c0 >= 2 for r in range(r0, min(r1, r0 + PROBE_ROWS) + 1)}
    shared, styles = dict(zip(piece["used"], piece["shared"])), [(bool(x & 2), bool(x & 1)) for x in piece["styles"]]
    parser = ET.XMLPullParser(("start", "end"))
    parser.feed(piece["xml"])  # the sheet's own opening tags, then whole rows; what follows them is not needed
    row, at = piece["before"], -1
    for event, e in parser.read_events():
        if _tag(e) == "row" and event == "start":
            row, at = int(e.get("r", row + 2)) - 1, -1
        elif _tag(e) == "row":
            e.clear()
        elif _tag(e) == "c" and event == "end":
            at = _place(e.get("r"))[1] if e.get("r") else at + 1
            style, date = styles[s] if (s := int(e.get("s", 0))) < len(styles) else (False, False)
            found = _value(e.get("t", "n"), next((x.text for x in e if _tag(x) == "v"), None), e, shared, date)
            if found and (rows is None or row < rows):
                yield row, at, found[0], found[1], style, row in wide
                if (row, at) in merged:
                    r1, c1 = merged[row, at]
                    for r in range(row, min(r1, row + PROBE_ROWS, rows - 1 if rows is not None else r1) + 1):
                        for c in range(at, min(c1, PROBE_COLS) + 1):
                            if (r, c) != (row, at):
                                yield r, c, None, found[1], style, r in wide


def as_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Cells as batches of at most ``BATCH``."""
    held = []
    for x in rows:
        held.append(x)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), TYPES)], schema=TYPES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), TYPES)], schema=TYPES)


def _parsed(rows: int | None):
    """Stage two: the cells of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from as_batches((p["path"], p["sheet"], *cell) for b in batches for i in range(b.num_rows) for p in b.slice(i, 1).to_pylist() for cell in cells_of(p, rows))

    return run


# Delimited text: Spark's line reader splits files; a first pass tells where each split's rows begin.


def _ends_open(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is still open after a line that begins in one or not; quotes open a field at its start alone."""
    if not inside and '"' not in line:
        return False
    at, end = 0, len(line)
    while True:
        if inside or (at < end and line[at] == '"'):
            at = _QUOTED.match(line, at if inside else at + 1).end()
            if at >= end:
                return True
            inside = False
        at = line.find(sep, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, start, line: where a line's split begins in its file, and the line without its end; in order in each split."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """(path, start) and lines, as text: what a batch has of one split."""
    for b in batches:
        paths, starts, lines = (c.to_pylist() for c in b.columns)
        k = 0
        while k < len(lines):
            end = k
            while end < len(lines) and (paths[end], starts[end]) == (paths[k], starts[k]):
                end += 1
            yield (paths[k], starts[k]), [x.decode("utf-8", "replace") for x in lines[k:end]]
            k = end


def _sep(path: str) -> str:
    return "\t" if path.lower().endswith(".tsv") else ","


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, were it to begin outside or inside of quotes: rows that end in it, and whether quotes are open after it."""
    seen: dict[tuple[str, int], list] = {}
    for key, lines in _splits(batches):
        own = seen.setdefault(key, [[0, False], [0, True]])
        for line in lines:
            if key[1] == 0:
                line = line.removeprefix("\ufeff")
            for x in own:
                x[1] = _ends_open(line, x[1], _sep(key[0]))
                x[0] += not x[1]
    rows = [{"path": p, "start": s, "n0": a[0], "open0": a[1], "n1": b[0], "open1": b[1]} for (p, s), (a, b) in seen.items()]
    yield pa.RecordBatch.from_pylist(rows, SPLITS)


def _records(begins: dict[tuple[str, int], tuple[int, bool]], parts: bool):
    """The cells of the rows that lie in one split or, with ``parts``, the pieces of those that several share."""

    def whole(key: tuple[str, int], records: list[tuple[int, str]]) -> Iterator[tuple]:
        name = _name(key[0])
        for (r, _), fields in zip(records, csv.reader([x for _, x in records], delimiter=_sep(key[0]))):
            for c, raw in enumerate(fields):
                if raw.strip():
                    yield key[0], name, r, c, raw, kind_of(raw), False, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        key, row, opened, held, shared = None, 0, False, [], False

        def part(text: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": key[0], "row": row, "start": key[1], "text": "\n".join(text)}], PARTS)

        for new, lines in _splits(batches):
            if new != key:
                if key and held and parts:
                    yield part(held)
                key, held = new, []
                row, opened = begins[new]
                shared = opened
            done = []
            for line in lines:
                held.append(line.removeprefix("\ufeff") if key[1] == 0 and row == 0 else line)
                opened = _ends_open(held[-1], opened, _sep(key[0]))
                if not opened:
                    if not shared:
                        done.append((row, "\n".join(held)))
                    elif parts:
                        yield part(held)
                    row, held, shared = row + 1, [], False
            if not parts:
                yield from as_batches(whole(key, done))
        if key and held and parts:
            yield part(held)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    for b in batches:
        for path, row, text in zip(*(c.to_pylist() for c in b.columns)):
            yield from as_batches((path, _name(path), row, c, raw, kind_of(raw), False, False) for fields in csv.reader([text], delimiter=_sep(path)) for c, raw in enumerate(fields) if raw.strip())


def _name(path: str) -> str:
    return posixpath.splitext(posixpath.basename(unquote(path)))[0]


def _delimited(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cells of text files, from any number of tasks a file.

    Row numbers and open quotes at a split's start come from sums over the
    splits before it, one small row each; a row that several splits share is put
    together by a shuffle of its pieces.  A line break in quotes comes as ``\\n``,
    quotes that are never closed end with the file, invalid bytes are replaced,
    a BOM is none of the text, and a blank line is a row without cells.
    """
    lines = _lines(spark, paths)
    begins: dict[tuple[str, int], tuple[int, bool]] = {}
    row, opened, last, shared = 0, False, None, False
    for x in sorted(lines.mapInArrow(_counted, "path string, start long, n0 long, open0 boolean, n1 long, open1 boolean").collect()):
        if x["path"] != last:
            row, opened, last = 0, False, x["path"]
        begins[x["path"], x["start"]] = row, opened
        row, opened = row + x["n1" if opened else "n0"], x["open1" if opened else "open0"]
        shared |= opened
    out = lines.mapInArrow(_records(begins, False), SCHEMA)
    if shared:
        pieces = lines.mapInArrow(_records(begins, True), "path string, row int, start long, text string")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n")
        out = out.unionAll(pieces.groupBy("path", "row").agg(text.alias("text")).mapInArrow(_joined, SCHEMA))
    return out


def _checked(path: str | list[str]) -> list[str]:
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not p.lower().endswith(SUFFIXES):
            raise IngestFailed(f"no reader for {posixpath.basename(p)!r}", suffixes=list(SUFFIXES))
    return paths


def cells(spark: SparkSession, path: str | list[str], rows: int | None = None) -> DataFrame:
    """The cells of a file or of many; with ``rows`` those of the first rows alone.

    Of a workbook no row beyond ``rows`` is parsed, and each sheet, or part of a
    large one, is parsed by a task of its own.
    """
    paths = _checked(path)
    text = [p for p in paths if p.lower().endswith((".csv", ".tsv"))]
    books = [p for p in paths if p not in text]
    found = []
    if text:
        found.append(_delimited(spark, text) if rows is None else _delimited(spark, text).where(F.col("row") < rows))
    if books:
        pieces = files(spark, books).select("path", "content").mapInArrow(_pieces(rows), "path string, sheet string, first int, before int, xml binary, merged array<int>, used array<int>, shared array<string>, styles array<int>")
        found.append(pieces.repartition("path", "sheet", "first").mapInArrow(_parsed(rows), SCHEMA))
    return found[0] if len(found) == 1 else found[0].unionAll(found[1])


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, length, content."""
    return spark.read.format("binaryFile").load(_checked(path)).select(F.col("_metadata.file_path").alias("path"), "length", "content")


def stats(spark: SparkSession, path: str | list[str], most: int | None = None) -> list[dict]:
    """path, length and SHA-256 (null beyond ``most`` bytes, which are not read) of each file, from one job."""
    f = files(spark, path)
    h = F.sha2("content", 256)
    sized = f.select("path", "length")
    if most is None:
        return [r.asDict() for r in f.select("path", "length", h.alias("hash")).collect()]
    large = [r.asDict() | {"hash": None} for r in sized.where(F.col("length") > most).collect()]
    return large + [r.asDict() for r in f.where(F.col("length") <= most).select("path", "length", h.alias("hash")).collect()]


def content_hash(spark: SparkSession, path: str, most: int | None = None) -> tuple[str | None, int]:
    """SHA-256 of a file (null beyond ``most`` bytes), and its length; both worked out where the file is read."""
    found = stats(spark, path, most)
    if not found:
        raise IngestFailed(f"{posixpath.basename(path)!r} is empty")
    return found[0]["hash"], found[0]["length"]

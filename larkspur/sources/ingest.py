"""From the cells of a file to typed tables.

A recipe says how one found table is read again; the rows are then made from all
cells in one shuffle by table and row number, typed by the expressions of
``functions.scalars``, and turned from wide to long where headers are periods.
Everything is keyed by file and table: any number of tables of one layout are
made together.  A recipe can be replayed on another file, whose headers are
looked for near the rows where they stood.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..copies import stored
from ..errors import IngestFailed
from ..functions.scalars import MISSING, parse_number, row_hash
from ..operators import layout
from ..operators.reshape import TOTALS
from .columns import SAMPLE, Column, confirm_sums, described, natures, slug
from .workbook import PROBE_ROWS


@dataclass(frozen=True)
class Recipe:
    sheet: str
    block: int
    kind: str
    r0: int
    r1: int
    c0: int
    c1: int
    body: int
    totals: int | None
    confidence: float
    columns: tuple[Column, ...]
    context: tuple[tuple[str, str, str], ...]  # slug, name, value
    path: str = ""
    head: int = 1  # rows of the header
    missing: tuple[float, ...] = MISSING  # numbers that stand for a missing value

    @property
    def layout(self) -> tuple:
        """What tables that are made together have in common."""
        return tuple((c.name, c.slug, c.role, c.kind, c.at - self.c0, c.month, c.year, c.derived, c.unit, c.counts is not None) for c in self.columns), tuple((s, n) for s, n, _ in self.context), self.missing

    @property
    def periods(self) -> list[Column]:
        return [c for c in self.columns if c.is_period and not c.derived]

    @property
    def kept(self) -> list[Column]:
        return [c for c in self.columns if not c.derived and not c.is_period]

    @property
    def range(self) -> str:
        return f"{letters(self.c0)}{self.r0 + 1}:{letters(self.c1)}{self.r1 + 1}"

    def to_dict(self) -> dict:
        return asdict(self) | {"range": self.range}

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        d = json.loads(text)
        return cls(**d | {"columns": tuple(Column(**c) for c in d["columns"]), "context": tuple(map(tuple, d["context"])), "missing": tuple(d.get("missing", MISSING))})


def letters(col: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    while col >= 0:
        out, col = chr(65 + col % 26) + out, col // 26 - 1
    return out


#: Rows above and below its place in which a header is looked for again, and the share of its labels that must be found there.
SLACK, ALIKE = 40, 0.7


def _placed(cells: DataFrame, recipes: list[Recipe], ends: bool = True) -> DataFrame:
    """table, row, k, raw: the cells of the recipes' bodies; ``table`` is a recipe's number, ``k`` the column's from 0.

    Without ``ends`` up to the sheet's last row.
    """
    rows = [(i, r.path, r.sheet, r.c0, r.c1, r.body, r.r1 if ends and r.r1 < PROBE_ROWS - 1 else None) for i, r in enumerate(recipes)]
    at = cells.sparkSession.createDataFrame(rows, "table int, in_path string, in_sheet string, c0 int, c1 int, body int, last int")
    here = (F.col("path") == F.col("in_path")) & (F.col("sheet") == F.col("in_sheet")) & F.col("col").between(F.col("c0"), F.col("c1")) & (F.col("row") >= F.col("body"))
    part = cells.where(F.col("raw").isNotNull()).join(at, here & (F.col("last").isNull() | (F.col("row") <= F.col("last"))))
    return part.select("table", "row", (F.col("col") - F.col("c0")).alias("k"), "raw")


def _before_gap(rows: DataFrame) -> DataFrame:
    """table, end: the last row of each table before its first blank row; rows: table, row, each once."""
    nexts = rows.select("table", (F.col("row") - 1).alias("row"))
    return rows.join(nexts, ["table", "row"], "left_anti").groupBy("table").agg(F.min("row").alias("end"))


def analyse(cells: DataFrame, missing: tuple[float, ...] = MISSING) -> list[Recipe]:
    """Recipes of the tables of all files; only layouts and samples reach the driver.  ``missing``: the numbers that stand for a missing value in them."""
    found = sorted(layout.blocks(cells).where("kind in ('table', 'crosstab')").collect(), key=lambda b: (b["path"], b["sheet"], b["block"]))
    if not found:
        raise IngestFailed("no table was found in this file")
    # the first rows of every table, in one pass: no two tables of a sheet share a cell
    first = [(k, b["path"], b["sheet"], b["c0"], b["c1"], b["body"], min(b["r1"], b["body"] + SAMPLE - 1), b["totals"]) for k, b in enumerate(found)]
    at = cells.sparkSession.createDataFrame(first, "table int, in_path string, in_sheet string, c0 int, c1 int, body int, last int, totals int")
    here = (F.col("path") == F.col("in_path")) & (F.col("sheet") == F.col("in_sheet")) & F.col("col").between(F.col("c0"), F.col("c1")) & F.col("row").between(F.col("body"), F.col("last"))
    # a copy, small as it is, so that no number is read beyond it
    part = stored(cells.where(F.col("raw").isNotNull()).join(F.broadcast(at), here & (F.col("totals").isNull() | (F.col("row") != F.col("totals")))).select("table", "row", "col", "raw", "kind"))
    seen: dict[int, dict[int, dict]] = {}
    for x in natures(part, missing).collect():
        seen.setdefault(x["table"], {})[x["col"]] = x.asDict()
    tables = [described(b["header"], b["c0"], seen.get(k, {})) for k, b in enumerate(found)]
    confirm_sums(part, tables, missing=missing)
    out = []
    for b, columns in zip(found, tables):
        taken = {c.slug for c in columns} | {"period", "period_month", "period_year", "value", "is_trace"}
        context = []
        for key, value in sorted((b["context"] or {}).items()):
            s = slug(key)
            while s in taken:
                s += "_context"
            taken.add(s)
            context.append((s, key, value))
        out.append(Recipe(*[b[k] for k in ("sheet", "block", "kind", "r0", "r1", "c0", "c1", "body", "totals", "confidence")], tuple(columns), tuple(context), b["path"], b["head"], tuple(missing)))
    return out


def located(cells: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """recipe, path, at: in each file the first row near a recipe's header that holds enough of its labels.

    The labels of a header of two rows are those of each two neighbouring rows.
    """
    rows = []
    for i, r in enumerate(recipes):
        labels = sorted({c.name.strip().lower() for c in r.columns if c.name != f"col_{c.at}"})
        top = r.body - r.head
        rows.append((i, r.sheet, r.c0, r.c1, top - SLACK, top + SLACK, r.head, labels, max(1, int(ALIKE * len(labels)))))
    want = cells.sparkSession.createDataFrame(rows, "recipe int, in_sheet string, c0 int, c1 int, low int, high int, head int, labels array<string>, least int")
    here = (F.col("sheet") == F.col("in_sheet")) & F.col("col").between(F.col("c0"), F.col("c1")) & F.col("row").between(F.col("low"), F.col("high") + F.col("head") - 1)
    said = F.lower(F.trim("raw"))
    first = F.struct(F.col("row").alias("at"), said.alias("one"), F.lit(None).cast("string").alias("two"))
    second = F.when(F.col("head") == 2, F.struct((F.col("row") - 1).alias("at"), F.lit(None).cast("string").alias("one"), said.alias("two")))
    d = cells.where(F.trim("raw") != "").join(want, here).select("recipe", "path", "col", "low", "high", "labels", "least", F.inline(F.array_compact(F.array(first, second))))
    d = d.where(F.col("at").between(F.col("low"), F.col("high"))).groupBy("recipe", "path", "at", "col", "labels", "least").agg(F.max("one").alias("one"), F.max("two").alias("two"))
    label = F.array_join(F.array_distinct(F.array_compact(F.array("one", "two"))), " / ")
    d = d.groupBy("recipe", "path", "at", "labels", "least").agg(F.collect_set(label).alias("seen"))
    return d.where(F.size(F.array_intersect("seen", "labels")) >= F.col("least")).groupBy("recipe", "path").agg(F.min("at").alias("at"))


def replay(cells: DataFrame, recipes: list[Recipe]) -> list[Recipe]:
    """The recipes as they hold in these files, in two passes and without a search for tables.

    Each file must have all headers.  A table then begins below its header and
    ends before its first blank row; what stood around it stays as stored.
    """
    found: dict[str, list[Recipe]] = {}
    for x in sorted(located(cells, recipes).collect(), key=lambda x: (x["path"], x["recipe"])):
        r = recipes[x["recipe"]]
        by = x["at"] + r.head - r.body
        found.setdefault(x["path"], []).append(replace(r, path=x["path"], r0=r.r0 + by, r1=r.r1 + by, body=r.body + by, totals=None))
    paths = {x["path"] for x in cells.select("path").distinct().collect()} if len(found) != 1 else set(found)
    if not found or any(len(found.get(p, [])) < len(recipes) for p in paths):
        raise IngestFailed("the stored layout's headers are not in this file", files=sorted(p for p in paths if len(found.get(p, [])) < len(recipes)))
    moved = [r for p in sorted(found) for r in found[p]]
    rows = _placed(cells, moved, False).groupBy("table", "row").agg(F.coalesce(F.max((F.col("k") < 2) & F.lower("raw").rlike(TOTALS)), F.lit(False)).alias("mark"))
    ended = rows.join(_before_gap(rows.select("table", "row")), "table").where("row <= end")
    extent = {x["table"]: x for x in ended.groupBy("table").agg(F.max("row").alias("end"), F.max(F.when(F.col("mark"), F.col("row"))).alias("totals")).collect()}
    if len(extent) < len(moved):
        raise IngestFailed("a header of the stored layout has no rows below it")
    return _recounted(cells, [replace(r, r1=extent[i]["end"], totals=extent[i]["totals"]) for i, r in enumerate(moved)])


def _recounted(cells: DataFrame, recipes: list[Recipe]) -> list[Recipe]:
    """The recipes, in which columns that count their rows do so from where they begin in these files, or no longer do."""
    if not any(c.counts is not None for r in recipes for c in r.columns):
        return recipes
    ends = cells.sparkSession.createDataFrame([(i, min(r.r1, r.body + SAMPLE - 1)) for i, r in enumerate(recipes)], "table int, stop int")
    part = _placed(cells, recipes).join(F.broadcast(ends), "table").where("row <= stop").select("table", "row", F.col("k").alias("col"), "raw", F.lit("").alias("kind"))
    seen = {(x["table"], x["col"]): x["counts"] for x in natures(stored(part), recipes[0].missing).collect()}
    new = lambda i, r, c: c if c.counts is None else replace(c, counts=seen.get((i, c.at - r.c0)))
    return [replace(r, columns=tuple(new(i, r, c) for c in r.columns)) for i, r in enumerate(recipes)]


def fingerprint(recipes: list[Recipe]) -> str:
    """The layout's hash: kinds, columns and headers, and missing codes if they are not the usual ones, whatever the number of rows."""
    codes = lambda r: "" if r.missing == MISSING else f":{r.missing}"
    said = "|".join(f"{r.sheet}:{r.kind}:{r.c0}-{r.c1}:" + ",".join(c.name for c in r.columns) + codes(r) for r in recipes)
    return hashlib.sha1(said.encode()).hexdigest()[:16]


def by_layout(recipes: list[Recipe]) -> list[list[int]]:
    """Numbers of the recipes that are made together."""
    out: dict[tuple, list[int]] = {}
    for i, r in enumerate(recipes):
        out.setdefault(r.layout, []).append(i)
    return list(out.values())


def wide(cells: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """One row for each row of the tables, totals rows too: table, row, is_total, and a text ``c<k>`` for each column.

    With ``n<k>`` for each column that counts its rows: the number that it has come to.
    The recipes are of one layout.
    """
    part = _placed(cells, recipes)
    if any(r.r1 >= PROBE_ROWS - 1 for r in recipes):  # a table that outgrows the probe ends before its first blank row
        part = part.join(_before_gap(part.select("table", "row").distinct()), "table").where(F.col("row") <= F.col("end"))
    r = recipes[0]
    rows = part.groupBy("table", "row").agg(*[F.max(F.when(F.col("k") == c.at - r.c0, F.col("raw"))).alias(f"c{c.at - r.c0}") for c in r.columns])
    label = lambda c: F.coalesce(F.lower(F.col(f"c{c.at - r.c0}")).rlike(TOTALS), F.lit(False))
    heads = [label(c) for c in r.columns[:2] if c.role != "measure"]
    total = heads[0] | heads[1] if len(heads) == 2 else heads[0] if heads else F.lit(False)
    if own := [c for c in r.columns if c.counts is not None]:
        ks = [c.at - r.c0 for c in own]
        starts = [(i, *[c.counts for c in x.columns if c.counts is not None]) for i, x in enumerate(recipes)]
        at = cells.sparkSession.createDataFrame(starts, "table int" + "".join(f", n{k} long" for k in ks))
        rows = rows.join(F.broadcast(at), "table").withColumns({f"n{k}": F.col(f"n{k}") + F.col("row") for k in ks})
    return rows.withColumn("is_total", total)


def _typed(c: Column, r: Recipe) -> Expr:
    raw = F.col(f"c{c.at - r.c0}")
    if c.kind == "double" and c.counts is not None:  # what it has come to is no missing code
        number, due = F.regexp_replace(raw, r"[,\s]", "").try_cast("double"), F.col(f"n{c.at - r.c0}")
        return F.when(number == due, number).otherwise(parse_number(raw, r.missing)["value"])
    if c.kind == "double":
        return parse_number(raw, r.missing)["value"]
    if c.kind == "long":
        return parse_number(raw, r.missing)["value"].cast("long")
    return F.nullif(F.trim(raw), F.lit(""))


def tables(cells: DataFrame, recipes: list[Recipe], keys: list[tuple[str, str, str]]) -> DataFrame:
    """The stored rows of tables of one layout: columns, context, value by period if there are any, and where each came from.

    keys: dataset, date and physical name of each; the name is the column ``_physical``.
    """
    r = recipes[0]
    facts = [(i, *key, *[v.strip(" ") for _, _, v in x.context]) for i, (x, key) in enumerate(zip(recipes, keys))]
    said = cells.sparkSession.createDataFrame(facts, "table int, _dataset_id string, _as_of_date string, _physical string" + "".join(f", x{k} string" for k in range(len(r.context))))
    d = wide(cells, recipes).where("not is_total").join(said, "table")
    keys_ = [_typed(c, r).alias(c.slug) for c in r.kept] + [F.col(f"x{k}").alias(s) for k, (s, _, _) in enumerate(r.context)]
    names = [c.slug for c in r.kept] + [s for s, _, _ in r.context]
    own_ = ["_dataset_id", "_as_of_date", "_physical"]
    trace = lambda c: parse_number(F.col(f"c{c.at - r.c0}"), r.missing)["is_trace"]
    if r.periods:
        long = F.array(*[
            F.struct(F.lit(c.name).alias("period"), F.lit(c.month).cast("long").alias("period_month"), F.lit(c.year).cast("long").alias("period_year"), F.col(f"c{c.at - r.c0}").alias("said"))
            for c in r.periods
        ])
        # made long first, so that a cell's text is read by one expression, not by one for each period
        d = d.select(*keys_, *own_, F.col("row"), F.inline(long)).withColumn("said", parse_number(F.col("said"), r.missing))
        d = d.withColumns({"value": F.col("said.value"), "is_trace": F.col("said.is_trace")}).drop("said")
        names += ["period", "period_month", "period_year", "value"]
    else:
        marks = [trace(c) for c in r.kept if c.role == "measure"]
        any_mark = marks[0] if marks else F.lit(False)
        for m in marks[1:]:
            any_mark = any_mark | m
        d = d.select(*keys_, *own_, F.col("row"), any_mark.alias("is_trace"))
    own = F.col("row").cast("long") + 1
    return d.select(
        *names, "_dataset_id", "_as_of_date", row_hash(*[F.col(n) for n in names], own).alias("_row_hash"), own.alias("_source_row"), "is_trace", "_physical",
    )


def table(cells: DataFrame, r: Recipe, dataset: str, as_of: str) -> DataFrame:
    """The stored rows of one table."""
    return tables(cells, [r], [(dataset, as_of, "")]).drop("_physical")


def checksums(cells: DataFrame, recipes: list[Recipe]) -> list[tuple[int, dict]]:
    """A recipe's number, and column_slug, stated_total, parsed_total, agrees for each measure of its last totals row, melted columns too; one pass over tables of one layout."""
    r = recipes[0]
    measures = [c for c in r.columns if c.role == "measure" and not c.derived]
    summed = [(i, x.totals) for i, x in enumerate(recipes) if x.totals is not None]
    if not measures or not summed:
        return []
    at = cells.sparkSession.createDataFrame(summed, "table int, totals int")
    sums = [F.sum(F.when(~F.col("is_total"), _typed(c, r))).alias(f"p{k}") for k, c in enumerate(measures)]
    said = [F.max(F.when(F.col("row") == F.col("totals"), _typed(c, r))).alias(f"s{k}") for k, c in enumerate(measures)]
    out = []
    for got in wide(cells, recipes).join(at, "table").groupBy("table").agg(*sums, *said).collect():
        for k, c in enumerate(measures):
            stated, parsed = got[f"s{k}"], got[f"p{k}"] or 0.0
            if stated is not None:
                out.append((got["table"], {"column_slug": c.slug, "stated_total": stated, "parsed_total": parsed, "agrees": abs(parsed - stated) <= max(0.01, abs(stated) * 1e-6)}))
    return out


def stored_columns(r: Recipe) -> list[Column]:
    """The columns as stored, for the catalog."""
    out = [*r.kept, *[Column(name, s, "dimension", "string", -1, sample=[v]) for s, name, v in r.context]]
    if r.periods:
        unit = next((c.unit for c in r.periods if c.unit), None) or next((v for s, _, v in r.context if s in ("unit", "units")), None)
        months, years = any(c.month for c in r.periods), any(c.year for c in r.periods)
        out.append(Column("period", "period", "dimension", "string", -1, sample=[c.name for c in r.periods][:20]))
        out += [Column("month", "period_month", "time", "long", -1)] * months + [Column("year", "period_year", "time", "long", -1)] * years
        section = next((v for s, _, v in r.context if s.endswith("section")), "")
        out.append(Column(f"value {section}".strip(), "value", "measure", "double", -1, unit))
    return out

"""Tables in sheets: where they start and end, their headers and what stands around them.

All sheets of all files are worked on together, as rows of cells that are
grouped by file, sheet and region, so a thousand workbooks take as many jobs as
one.  A sheet's probe has at most 2000 x 512 cells.

1. A row of one text, or of texts under a wide merged range, stands alone.
2. The rest is cut at blank rows and columns, level by level (``_cut``).
3. Parts of a region that no chain of neighbours joins are islands (``_islands``).
4. A row that looks like a header inside a block begins another (``_unstack``).
5. Headers, kinds and totals come from one aggregate over blocks (``_named``).
6. Names and pairs of values above a table are its context (``_around``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..copies import stored
from ..sources.workbook import PROBE_COLS, PROBE_ROWS
from .reshape import TOTALS

BLOCKS = "path string, sheet string, block int, kind string, r0 int, r1 int, c0 int, c1 int, body int, head int, header array<string>, context map<string,string>, totals int, confidence double"
# Weights of a header's score, and the scores that count.
WEIGHTS = {"text": 0.34, "differs": 0.28, "styled": 0.16, "unique": 0.10, "dense": 0.12}
HEADER, SECOND_HEADER, STACKED_HEADER, ABOVE_STACKED = 0.45, 0.62, 0.70, 0.55
HEADER_ROWS, BODY_ROWS, DEEPEST = 4, 8, 10
# Confidences of blocks, and what shares of fitting cells add to them.
FRAGMENT, BANNER, PAIRS, CROSSTAB, TABLE, SURE = 0.3, 0.9, (0.75, 0.2), (0.6, 0.3), 0.15, 0.99

SHEET = ["path", "sheet"]
BOX = ["r0", "r1", "c0", "c1"]
BLOCK = [*SHEET, *BOX]


def _if(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _box() -> list[Column]:
    return [F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")]


def _inside(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """The cells of each block, with its box; blocks of a sheet may overlap."""
    here = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    b = blocks.select(F.col("path").alias("b_path"), F.col("sheet").alias("b_sheet"), *BOX)
    return cells.join(b, (F.col("path") == F.col("b_path")) & (F.col("sheet") == F.col("b_sheet")) & here).drop("b_path", "b_sheet")


def _cut(rest: DataFrame) -> DataFrame:
    """path, sheet, region, row, col: regions between blank rows and columns.

    A level cuts each region at all gaps of the axis that has the widest; of
    equally wide ones, at the rows.
    """
    d = rest.select(*SHEET, F.lit("").alias("region"), "row", "col")
    key = Window.partitionBy(*SHEET, "region")
    for _ in range(DEEPEST):
        axis = {"row": key.orderBy("row"), "col": key.orderBy("col")}
        d = d.select("*", *[(F.col(a) - F.lag(a).over(w)).alias(f"{a}_step") for a, w in axis.items()])
        d = d.select("*", *[F.sum((F.col(f"{a}_step") > 1).cast("int")).over(w).alias(f"{a}_part") for a, w in axis.items()], *[F.coalesce(F.max(f"{a}_step").over(key), F.lit(1)).alias(f"{a}_gap") for a in axis])
        cut = F.when(F.greatest("row_gap", "col_gap") <= 1, F.lit(None)).when(F.col("row_gap") >= F.col("col_gap"), F.coalesce("row_part", F.lit(0))).otherwise(F.coalesce("col_part", F.lit(0)))
        d = stored(d.select(*SHEET, "region", "row", "col", cut.alias("cut")))
        if d.where("cut is not null").isEmpty():
            break
        d = d.select(*SHEET, F.concat_ws("/", "region", F.coalesce("cut", F.lit(0))).alias("region"), "row", "col")
    return d.select(*SHEET, "region", "row", "col")


def _components(edges: DataFrame) -> DataFrame:
    """node, least: the least node that each reaches, by taking the least label around and then that label's own label until none changes."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    label = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("least")))
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("least").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = label.join(near, "node").select("node", F.least("least", "theirs").alias("low"), F.col("least").alias("was"))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("further"))
        new = stored(step.join(jump, "low").select("node", F.least("low", "further").alias("least"), "was"))
        label = new.select("node", "least")
        if new.where("least <> was").isEmpty():
            return label


def _islands(regions: DataFrame) -> DataFrame:
    """path, sheet and box of the parts of each region that no chain of neighbours joins, once every cell has grown by one to its four sides.

    Runs of grown cells in a row are nodes; those that touch in neighbouring rows
    are joined.  A region with one run a row, each touching the next, is one part;
    only others are looked at as graphs.
    """
    own = [*SHEET, "region"]
    box = regions.groupBy(*own).agg(*_box())
    large = box.where("r1 - r0 >= 3 and c1 - c0 >= 3")
    around = F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    grown = regions.join(large, own).select(*own, *BOX, F.inline(around)).where("row between r0 and r1 and col between c0 and c1").select(*own, "row", "col").distinct()
    in_row = F.col("col") - F.row_number().over(Window.partitionBy(*own, "row").orderBy("col"))
    runs = stored(grown.withColumn("run", in_row).groupBy(*own, "row", "run").agg(F.min("col").alias("x"), (F.max("col") + 1).alias("y")).drop("run"))
    w = Window.partitionBy(*own).orderBy("row", "x")
    apart = ~((F.col("x") <= F.lag("y").over(w)) & (F.lag("x").over(w) <= F.col("y")) & (F.lag("row").over(w) == F.col("row") - 1))
    many = stored(runs.withColumn("apart", _if(apart)).groupBy(*own).agg(F.max("apart").alias("apart")).where("apart").select(*own))
    if many.isEmpty():
        return box.select(*BLOCK).distinct()
    runs = runs.join(many, own).withColumn("node", F.struct(*own, "row", "x"))
    below = runs.select(*own, (F.col("row") - 1).alias("row"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("node").alias("b"))
    touching = runs.join(below, [*own, "row"]).where("x <= v and u <= y").select(F.col("node").alias("a"), "b")
    found = _components(runs.select(F.col("node").alias("a"), F.col("node").alias("b")).unionAll(touching))
    labelled = runs.join(found, "node").select(*own, "row", "x", "y", "least")
    parts = regions.join(labelled, [*own, "row"]).where("col >= x and col < y").groupBy(*SHEET, "least").agg(*_box())
    return box.join(many, own, "left_anti").select(*BLOCK).unionAll(parts.select(*BLOCK)).distinct()


def _scores(k: DataFrame) -> DataFrame:
    """block, row, score: how much each row of a block looks like the header of what is below it; k: cells of blocks.

    Of a column's kinds in the rows below, the commonest counts; of equally
    common ones, the first seen.
    """
    n = F.count("*")
    row = k.groupBy(*BLOCK, "row").agg(n.alias("n"), F.count_if(F.col("kind") == "TEXT").alias("texts"), F.max("styled").alias("styled"), F.count_distinct(F.coalesce("said", F.lit("None"))).alias("labels"))
    below = k.select(*BLOCK, "col", "kind", "row", F.explode(F.sequence(F.lit(1), F.lit(BODY_ROWS + 1))).alias("by")).select(*BLOCK, "col", "kind", (F.col("row") - F.col("by")).alias("row"), "by").where("row >= r0")
    usual = below.groupBy(*BLOCK, "row", "col", "kind").agg(n.alias("n"), F.min("by").alias("by")).groupBy(*BLOCK, "row", "col").agg(F.max_by("kind", F.struct("n", -F.col("by"))).alias("usual"))
    differ = k.join(usual, [*BLOCK, "row", "col"]).where("kind <> usual").groupBy(*BLOCK, "row").agg(n.alias("differ"))
    width = F.col("c1") - F.col("c0") + 1
    parts = {"text": F.col("texts") / F.col("n"), "differs": F.coalesce("differ", F.lit(0)) / width, "styled": F.col("styled").cast("double"), "unique": F.col("labels") / F.col("n"), "dense": F.col("n") / width}
    score = F.lit(0.0)
    for part, weight in WEIGHTS.items():
        score = score + F.lit(weight) * parts[part]
    return row.join(differ, [*BLOCK, "row"], "left").select(*BLOCK, "row", score.alias("score"))


def _unstack(cells: DataFrame, rest: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks, cut above each row inside a part that is clearly a header while the row before it isn't, and shrunk to their cells."""
    tall = parts.where("r1 - r0 >= 5")
    s = _scores(_inside(cells, tall))
    before = s.select(*BLOCK, (F.col("row") + 1).alias("row"), F.col("score").alias("above"))
    heads = s.where((F.col("score") >= STACKED_HEADER) & F.expr("row between r0 + 2 and r1 - 2")).join(before, [*BLOCK, "row"], "left").where(F.coalesce("above", F.lit(0.0)) < ABOVE_STACKED)
    starts = parts.join(heads.groupBy(*BLOCK).agg(F.sort_array(F.collect_list("row")).alias("heads")), BLOCK, "left")
    starts = starts.withColumn("starts", F.concat(F.array("r0"), F.coalesce("heads", F.array().cast("array<int>"))))
    pieces = F.expr("transform(starts, (x, i) -> named_struct('a', x, 'b', case when i + 1 < size(starts) then starts[i + 1] - 1 else r1 end))")
    cut = starts.select(*SHEET, "c0", "c1", F.size("starts").alias("n"), "r0", "r1", F.inline(pieces)).where("n = 1 or b > a").select(*SHEET, F.col("a").alias("r0"), F.col("b").alias("r1"), "c0", "c1")
    # a part that is not cut may be one row; of cut ones no single row is kept
    return stored(_inside(rest, cut).groupBy(*BLOCK).agg(F.min("row").alias("n0"), F.max("row").alias("n1"), F.min("col").alias("m0"), F.max("col").alias("m1"))
                  .select(*SHEET, F.col("n0").alias("r0"), F.col("n1").alias("r1"), F.col("m0").alias("c0"), F.col("m1").alias("c1")).distinct())


def _headers(k: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, first, head, score: a header's first row, its rows (none, one or two) and the score of the first, the best of those at the top."""
    s = _scores(k.where(F.col("row") <= F.col("r0") + HEADER_ROWS + BODY_ROWS + 1)).where(F.col("row") <= F.col("r0") + HEADER_ROWS)
    top = F.when((F.col("row") < F.least(F.col("r0") + HEADER_ROWS, F.col("r1"))) & (F.col("score") > 0), F.struct("score", (-F.col("row")).alias("up")))
    best = s.groupBy(*BLOCK).agg(F.max(top).alias("best"), F.map_from_entries(F.collect_list(F.struct("row", "score"))).alias("scores"))
    d = blocks.join(best, BLOCK, "left").select(*BLOCK, F.coalesce(-F.col("best.up"), F.col("r0")).alias("first"), F.coalesce("best.score", F.lit(0.0)).alias("score"), "scores")
    second = _if((F.col("score") > 0) & (F.col("first") + 1 < F.col("r1")) & (F.try_element_at("scores", F.col("first") + 1) > SECOND_HEADER))
    return d.select(*BLOCK, "first", "score", F.when(F.col("r1") == F.col("r0"), F.lit(0)).otherwise(F.lit(1) + second.cast("int")).alias("head"))


def _named(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, kind, confidence, body, head, header, totals, from one aggregate over the blocks' cells."""
    k = stored(_inside(cells, blocks))
    h = _headers(k, blocks).withColumn("body", F.when(F.col("head") > 0, F.col("first") + F.col("head")).otherwise(F.col("r0")))
    d = k.join(h, BLOCK)
    text, left, right, inner = F.col("kind") == "TEXT", F.col("col") == F.col("c0"), F.col("col") == F.col("c1"), F.col("col") > F.col("c0")
    below, at_head = F.col("row") >= F.col("body"), (F.col("head") > 0) & (F.col("row") == F.col("first"))
    height, width = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    # a long block whose values differ in kind in its first row alone has a header there
    value = right & ((height <= BODY_ROWS) | (F.col("row") > F.col("r0")))
    label = (F.col("head") > 0) & F.col("row").between(F.col("first"), F.col("body") - 1) & F.col("said").isNotNull()
    marked = below & (F.col("col") <= F.col("c0") + 1) & F.lower("said").rlike(TOTALS)
    a = d.groupBy(*BLOCK, "first", "head", "body", "score").agg(
        F.count_if(left & text).alias("left_texts"), F.count_if(right).alias("rights"), F.count_if(right & text).alias("right_texts"), F.count_distinct(F.when(value, F.col("kind"))).alias("value_kinds"),
        F.max(F.when(F.col("row") == F.col("r0"), F.col("styled"))).alias("styled"), F.count_if(at_head & inner).alias("heads"), F.count_if(at_head & inner & F.col("kind").isin("DATE", "NUM")).alias("periods"),
        F.count_if(below & inner).alias("inner"), F.count_if(below & inner & (F.col("kind") == "NUM")).alias("numbers"), F.count_if(below & left & text).alias("names"), F.max(F.when(marked, F.col("row"))).alias("marked"),
        F.sort_array(F.collect_list(F.when(label, F.struct("col", "row", "said")))).alias("labels"),
    )
    # names and texts without a header, few rows: pairs too, though all values are of one kind
    paired = (F.col("value_kinds") > 1) | ((height <= 3) & (F.col("right_texts") == height))
    pairs = (width == 2) & ~_if(F.col("styled")) & (F.col("left_texts") / height >= 0.8) & (F.col("rights") / height >= 0.6) & paired
    numeric = F.col("numbers") / F.greatest(F.col("inner"), F.lit(1))
    cross = (width >= 3) & (height >= 3) & (F.col("head") > 0) & (F.col("heads") > 0) & (F.col("heads") == F.col("periods")) & (numeric >= 0.75) & (F.col("names") / (F.col("r1") - F.col("body") + 1) >= 0.7)
    table = (height >= 3) & (width >= 2) & (F.col("score") >= HEADER)
    tests = (
        ((height == 1) & (width != 2), "banner", F.lit(BANNER)), (pairs, "key_value", PAIRS[0] + PAIRS[1] * F.col("left_texts") / height), (height == 1, "banner", F.lit(BANNER)),
        (cross, "crosstab", CROSSTAB[0] + CROSSTAB[1] * numeric), (table, "table", F.least(F.lit(SURE), F.col("score") + TABLE)), (F.lit(True), "fragment", F.lit(FRAGMENT)),
    )
    pick = F.lit(None)
    for test, kind, sure in reversed(tests):
        pick = F.when(_if(test), F.struct(F.lit(kind).alias("kind"), sure.cast("double").alias("confidence"))).otherwise(pick)
    said = "array_join(array_distinct(transform(filter(labels, x -> x.col = c), x -> x.said)), ' / ')"
    header = F.expr(f"transform(sequence(c0, c1), c -> coalesce(nullif({said}, ''), concat('col_', c)))")
    held = F.col("p.kind").isin("table", "crosstab", "fragment")
    return a.withColumn("p", pick).select(
        *BLOCK, "p.kind", "p.confidence", F.when(held, F.col("body")).otherwise(F.lit(0)).alias("body"), F.when(held, F.col("head")).otherwise(F.lit(0)).alias("head"),
        F.when(held, header).otherwise(F.array().cast("array<string>")).alias("header"), F.when(F.col("p.kind").isin("table", "crosstab"), F.col("marked")).alias("totals"),
    )


def _facts(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, sheet, box, row, key, value: what banners and pairs of values say."""
    d = _inside(cells.where("raw is not null"), blocks.where("kind in ('banner', 'key_value')")).join(blocks.select(*BLOCK, F.col("kind").alias("block_kind")), BLOCK)
    section = d.where("block_kind = 'banner' and row = r0").groupBy(*BLOCK, "row").agg(F.lit("_section").alias("key"), F.min_by("said", "col").alias("value"))
    side = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("raw")))
    pairs = d.where("block_kind = 'key_value'").groupBy(*BLOCK, "row").agg(side("c0").alias("key"), side("c1").alias("value")).where("key is not null and value is not null")
    plain = F.regexp_replace(F.regexp_replace(F.lower(_bare("key")), ":+$", ""), r"\s+", "_")
    return section.unionAll(pairs.withColumn("key", plain).select(*section.columns))


def _around(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, sheet, box, context: what stands over the first table, and over a table what stands between it and the table before it; the nearer counts."""
    tables = blocks.where("kind in ('table', 'crosstab')").select(*BLOCK)
    beside = lambda a, b: (F.col(f"{a}.c1") < F.col(f"{b}.c0")) | (F.col(f"{b}.c1") < F.col(f"{a}.c0"))
    same = lambda a, b: (F.col(f"{a}.path") == F.col(f"{b}.path")) & (F.col(f"{a}.sheet") == F.col(f"{b}.sheet"))
    above = F.when(_if((F.col("o.r1") < F.col("t.r0")) & ~beside("o", "t")), F.col("o.r1"))
    walls = tables.alias("t").join(tables.alias("o"), same("t", "o")).groupBy(*[F.col(f"t.{c}").alias(c) for c in BLOCK]).agg(F.coalesce(F.max(above), F.lit(-1)).alias("wall"), F.min("o.r0").alias("top"))
    near = (F.col("d.r1") >= F.col("t.top")) & (F.col("d.r1") < F.col("t.r0")) & (F.col("d.r1") > F.col("t.wall")) & ~beside("d", "t")
    told = walls.alias("t").join(_facts(cells, blocks).alias("d"), same("t", "d") & ((F.col("d.r1") < F.col("t.top")) | near))
    last = told.groupBy(*[F.col(f"t.{c}").alias(c) for c in BLOCK], F.col("d.key").alias("key")).agg(F.max_by("d.value", F.struct("d.r1", "d.r0", "d.c0", "d.row")).alias("value"))
    return last.where("value <> ''").groupBy(*BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("context"))


def _bare(name: str) -> Column:
    """A text without white space around it."""
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def blocks(cells: DataFrame) -> DataFrame:
    """All blocks of all sheets, in the columns of ``BLOCKS``."""
    probe = stored(cells.where(f"row < {PROBE_ROWS} and col < {PROBE_COLS}").select(*SHEET, "row", "col", "raw", _bare("raw").alias("said"), "kind", "styled", "wide"))
    per = probe.groupBy(*SHEET, "row").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "TEXT").alias("texts"), F.max("wide").alias("wide"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    lone = stored(per.where("texts = n and (n = 1 or wide)").select(*SHEET, "row", "c0", "c1"))
    rest = probe.join(lone.select(*SHEET, "row"), [*SHEET, "row"], "left_anti").select(*SHEET, "row", "col")
    parts = stored(_islands(_cut(rest)))
    none = F.lit(0)
    banners = lone.select(
        *SHEET, F.col("row").alias("r0"), F.col("row").alias("r1"), "c0", "c1", F.lit("banner").alias("kind"), F.lit(BANNER).alias("confidence"), none.alias("body"), none.alias("head"),
        F.array().cast("array<string>").alias("header"), F.lit(None).cast("int").alias("totals"),
    )
    found = stored(_named(probe, _unstack(probe, rest, parts)).unionAll(banners))
    kept = found.where("kind <> 'fragment' or (r1 - r0 + 1) * (c1 - c0 + 1) > 4").join(_around(probe, found), BLOCK, "left")
    no = F.row_number().over(Window.partitionBy(*SHEET).orderBy("r0", "c0", "r1", "c1")) - 1
    context = F.coalesce("context", F.create_map().cast("map<string,string>"))
    return kept.withColumn("block", no).withColumn("context", context).select(*[c.split()[0] for c in BLOCKS.replace("map<string,string>", "map").split(", ")])

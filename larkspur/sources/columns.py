"""What the columns of a found table hold: roles, units, periods and sums of other columns.

One aggregate over the typed cells of all tables' first ``SAMPLE`` rows tells the
nature of every column, a second one compares columns that may be sums with the
columns they may sum up.  Only these figures reach the driver; the whole tables
are then read by what was found here.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MISSING, MONTHS, SEASONS, parse_number

SAMPLE = 200

# Names of time columns, units, and names of columns that may be sums.
TIME_NAMES = {"year", "date", "month", "day", "time", "period", "datetime", "timestamp", "as_of", "as_of_date", "obs_date", "observation_date", "yr"}
UNIT_SIGNS = {"c": "degC", "°c": "degC", "t": "tonnes", "mm": "mm", "%": "percent"}
UNITS = {"rainfall": "mm", "temperature": "degC", "pressure": "hPa", "wind speed": "kmph", "humidity": "percent", "olr": "W/m2", "sst": "degC", "precipitable water": "mm"}
SUM_NAMES = {"annual", "total", "sum", "overall", "seasonal"}


@dataclass
class Column:
    name: str
    slug: str
    role: str
    kind: str  # double, long or string
    at: int  # the sheet's column
    unit: str | None = None
    month: int | None = None
    year: int | None = None
    derived: bool = False
    derived_of: list[str] = field(default_factory=list)
    null_fraction: float = 0.0
    sample: list[str] = field(default_factory=list)
    counts: int | None = None  # in a column that goes up by one with each row, the number that the sheet's row 0 would have

    @property
    def is_period(self) -> bool:
        return self.month is not None or self.year is not None

    def to_dict(self) -> dict:
        return asdict(self)


def slug(name: str, otherwise: str = "col") -> str:
    """Letters and digits of a name in lower case, joined by underscores; accents are dropped."""
    plain = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode()
    return "_".join(re.findall("[a-z0-9]+", plain.lower())) or otherwise


def fresh(name: str, taken: set[str]) -> str:
    """``name``, or with the first number from 2 on that makes it a new one; it is taken from then on."""
    no, out = 2, name
    while out in taken:
        out, no = f"{name}_{no}", no + 1
    taken.add(out)
    return out


def identifier(name: str) -> str:
    """A table's name: letters, digits and single underscores, 60 at most."""
    return re.sub(r"_+", "_", re.sub(r"\W", "_", name, flags=re.ASCII)).strip("_")[:60] or "t"


def unit_of(name: str) -> str | None:
    """What stands in a name's brackets, if it can be a unit, else the unit of what the name speaks of."""
    for left, right in ("()", "[]"):
        said = name.partition(left)[2].partition(right)[0].strip().lower()
        if said and all(c.isalpha() or c in "°%/" for c in said):
            return UNIT_SIGNS.get(said, said)
    spoken = [u for what, u in UNITS.items() if what in name.lower()]
    return spoken[0] if spoken else None


def period_of(label: str) -> tuple[int | None, int | None]:
    """(month, year) that a header names; a date names both."""
    t = str(label).strip().lower()
    if re.fullmatch(r"(19|20)\d\d(\.0)?", t):
        return None, int(t[:4])
    if m := re.match(r"(\d{4})-(\d\d)-\d\d", t):
        return int(m[2]), int(m[1])
    return next((k for k, n in enumerate(MONTHS, 1) if t in (n, n[:3])), None), None


def natures(cells: DataFrame, missing: tuple[float, ...] = MISSING) -> DataFrame:
    """table, col, rows, present, dated, numeric, unique, yearly, sample, counts for each column with a cell; cells: table, row, col, raw, kind.

    Blank cells and missing codes are not present; a column is numeric if four
    fifths of what is present are numbers, traces among them.  One of which all
    numbers are as far from their rows' numbers ``counts`` from there.
    """
    c = cells.select("table", "row", "col", "kind", F.trim("raw").alias("said"), parse_number(F.col("raw"), missing).alias("p"))
    here, value = ~F.col("p.is_missing"), F.col("p.value")
    year = value.between(1800, 2200) & (value == F.floor(value))
    ahead = value - F.col("row")
    per = c.groupBy("table", "col").agg(
        F.count_if(here).alias("present"), F.count("p.value").alias("numbers"), F.count_if(F.col("kind") == "DATE").alias("dates"),
        F.count_if(year).alias("years"), F.collect_set(F.when(here, F.col("said"))).alias("seen"),  # of ``SAMPLE`` rows
        F.min(ahead).alias("least"), F.max(ahead).alias("most"),
    )
    rows = c.groupBy("table").agg(F.count_distinct("row").alias("rows"))
    return per.join(rows, "table").select(
        "table", "col", "rows", "present", (F.col("dates") > 0).alias("dated"), (5 * F.col("numbers") >= 4 * F.greatest("present", F.lit(1))).alias("numeric"),
        ((F.size("seen") == F.col("present")) & (F.col("present") > 2)).alias("unique"), ((F.col("years") == F.col("present")) & (F.col("present") > 0)).alias("yearly"),
        F.slice(F.sort_array("seen"), 1, 20).alias("sample"),
        F.when((F.col("numbers") > 2) & (F.col("numbers") == F.col("present")) & (F.col("least") == F.col("most")) & (F.col("least") == F.floor("least")), F.col("least").cast("long")).alias("counts"),
    )


#: A column that no cell was seen in.
_EMPTY = {"rows": 1, "present": 0, "dated": False, "numeric": False, "unique": False, "yearly": False, "sample": [], "counts": None}


def described(header: list[str], first: int, seen: dict[int, dict]) -> list[Column]:
    """One ``Column`` for each header, from the rows of ``natures`` by sheet column."""
    out, taken = [], set()
    for at, name in enumerate(header, first):
        is_, plain, (month, year) = seen.get(at, _EMPTY), slug(name), period_of(name)
        c = Column(name, fresh(plain, taken), "dimension", "string", at, null_fraction=1 - is_["present"] / is_["rows"], sample=list(is_["sample"]))
        if month or year:
            c.role = "measure"
        elif is_["dated"] or plain in TIME_NAMES:
            c.role, c.kind = "time", "long" if is_["yearly"] else "string"
        elif is_["numeric"]:
            c.role = "measure"
        if c.role == "measure" and is_["unique"] and "id" in plain.split("_"):
            c.role = "identifier"
        if c.role == "measure":
            c.kind, c.unit, c.month, c.year = "double", unit_of(name), month, year
            c.counts = None if c.is_period else is_["counts"]
        out.append(c)
    return out


def claims(columns: list[Column]) -> list[tuple[Column, list[Column]]]:
    """Measures whose names say that they sum up others, and the ones they may sum up: a season its months, else all periods, else all measures."""
    measures = [c for c in columns if c.role == "measure"]
    season = {c.slug: SEASONS.get(c.name.strip().upper()) for c in measures}
    sums = [c for c in measures if season[c.slug] or SUM_NAMES & set(slug(c.name).split("_"))]
    rest = [c for c in measures if c not in sums]
    periods = [c for c in rest if c.is_period] or rest
    made = [(c, [p for p in rest if p.month in season[c.slug]] if season[c.slug] else periods) for c in sums if not c.is_period]
    return [(c, of) for c, of in made if len(of) > 1]


def confirm_sums(cells: DataFrame, tables: list[list[Column]], within: float = 0.02, least: int = 3, share: float = 0.8, missing: tuple[float, ...] = MISSING) -> None:
    """Marks the claimed sums that the numbers bear out, row by row, in one aggregate for all tables; a name alone is not enough."""
    claimed = {(t, c.at): (c, of) for t, columns in enumerate(tables) for c, of in claims(columns)}
    if not claimed:
        return
    links = [(t, at, p.at, False) for (t, at), (_, of) in claimed.items() for p in of] + [(t, at, at, True) for t, at in claimed]
    links = F.broadcast(cells.sparkSession.createDataFrame(links, "table int, claim int, col int, stated boolean"))  # of headers alone
    v = cells.select("table", "row", "col", parse_number(F.col("raw"), missing)["value"].alias("v")).where("v is not null").join(links, ["table", "col"])
    per = v.groupBy("table", "claim", "row").agg(F.sum(F.when(F.col("stated"), F.col("v"))).alias("stated"), F.sum(F.when(~F.col("stated"), F.col("v"))).alias("parts"))
    near = F.abs(F.col("parts") - F.col("stated")) <= F.abs("stated") * within
    for r in per.where("stated is not null and parts is not null").groupBy("table", "claim").agg(F.count("*").alias("n"), F.count_if(near).alias("agreed")).collect():
        if r["n"] >= least and r["agreed"] >= share * r["n"]:
            c, of = claimed[r["table"], r["claim"]]
            c.derived, c.derived_of = True, [p.slug for p in of]

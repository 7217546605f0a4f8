"""English questions to plans, without a language model.

Time expressions are taken out first, then the top-n and the grouping, the
words for an aggregate, comparisons and values; what is left names the measure.
Every step stays on the driver and works on column names and value lists; the
plan it makes is the only thing that touches the data.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

from .errors import AmbiguousQuery, Unanswerable
from .functions.scalars import MONTHS, SEASONS
from .plans.plan import Filter, Normals, Plan, TimeSpec, compile_plan

# Names of seasons, and words for aggregates and orders.
SEASON_NAMES = {
    "jf": "JF", "winter": "JF", "cold weather": "JF",
    "mam": "MAM", "pre-monsoon": "MAM", "pre monsoon": "MAM", "premonsoon": "MAM", "hot weather": "MAM", "summer": "MAM",
    "jjas": "JJAS", "monsoon": "JJAS", "southwest monsoon": "JJAS", "sw monsoon": "JJAS", "rainy season": "JJAS",
    "ond": "OND", "post-monsoon": "OND", "post monsoon": "OND", "postmonsoon": "OND", "northeast monsoon": "OND", "ne monsoon": "OND", "retreating monsoon": "OND",
}
#: A year, and two years that a word or a dash joins to a range.
YEAR = r"(?:18|19|20|21)\d\d"
YEAR_RANGE = rf"\b(?:(?:between|from)\s+)?({YEAR})\s*(?:-|–|\b(?:to|until|through|and)\b)\s*({YEAR})\b"
AGGREGATE_WORDS = (
    ("sum", ("total", "sum", "combined", "aggregate", "cumulative", "overall")), ("avg", ("average", "mean", "avg", "typical", "normal")),
    ("max", ("maximum", "highest", "max", "peak", "largest", "wettest", "hottest")), ("min", ("minimum", "lowest", "min", "smallest", "driest", "coolest")),
    ("count", ("count", "how many", "number of", "frequency")),
)
ASCENDING_WORDS = ("bottom", "lowest", "least", "driest", "smallest", "minimum", "coolest")
# Units and parts of names of measures that are averaged unless a question says otherwise.
AVERAGED_UNITS = ("degC", "percent", "hPa", "kmph")
AVERAGED_NAMES = ("temp", "humidity", "pressure", "uptime", "percent", "ratio", "index")
COMPARISONS = ((">=", ("at least", "no less than", ">=")), ("<=", ("at most", "no more than", "<=")), (">", ("above", "over", "more than", "greater than", "exceeding", ">")), ("<", ("below", "under", "less than", "fewer than", "<")))
FILLER = set("the a an of in on at by for during per each and what is was were are how many me show list give which with from to all please top bottom".split())


# Other words for a measure, by what its column's name holds, and former names of places.
SYNONYMS = {
    "rainfall": ("rain", "precipitation", "rf", "precip", "showers"), "temperature": ("temp", "thermal"),
    "max_temp": ("maximum temperature", "highest temperature", "tmax"), "min_temp": ("minimum temperature", "lowest temperature", "tmin"),
    "humidity": ("rh", "relative humidity"), "pressure": ("mslp", "barometric"), "wind": ("windspeed", "gust"),
    "olr": ("outgoing longwave radiation",), "sst": ("sea surface temperature",), "observations": ("obs", "count", "records"), "rainy_days": ("wet days", "rain days"),
}
FORMER_NAMES = {
    "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai", "bangalore": "bengaluru", "poona": "pune", "trivandrum": "thiruvananthapuram", "pondicherry": "puducherry",
    "gurgaon": "gurugram", "baroda": "vadodara", "calicut": "kozhikode", "ooty": "udagamandalam", "allahabad": "prayagraj", "cherrapunjee": "sohra", "cherrapunji": "sohra",
    "mysuru": "mysore", "warangal": "hanamkonda", "simla": "shimla", "benares": "varanasi", "cochin": "kochi", "mangalore": "mangaluru", "belgaum": "belagavi", "hubli": "hubballi",
}
#: A misspelt word stands for one with the same first letters and at least this likeness; at most so many values are taken.
ALIKE, FIRST_LETTERS, RESCUED = 0.72, 3, 3
#: Words of at least so many letters that begin alike explain each other.
STEM = 4


@dataclass(frozen=True)
class Column:
    name: str
    role: str  # measure, dimension, time, or date: what year and month are parts of
    terms: tuple[str, ...]
    unit: str = ""
    also: tuple[str, ...] = ()  # phrases that mean it too
    label: str = ""
    places: tuple[str, ...] = ()  # names of the sheet and the file it stands in


SALES = (
    Column("l_extendedprice", "measure", ("extended", "price")), Column("l_quantity", "measure", ("quantity",)), Column("l_discount", "measure", ("discount",), "percent"),
    Column("l_suppkey", "dimension", ("supplier",)), Column("l_returnflag", "dimension", ("return", "flag")), Column("l_linestatus", "dimension", ("line", "status")),
    Column("year", "time", ("year",)), Column("period_month", "time", ("month",)), Column("l_shipdate", "date", ("ship", "date")),
)
ORDERS = (
    Column("o_totalprice", "measure", ("total", "price", "orders")), Column("o_orderpriority", "dimension", ("priority",)), Column("o_orderstatus", "dimension", ("order", "status")),
    Column("year", "time", ("year",)), Column("period_month", "time", ("month",)), Column("o_orderdate", "date", ("order", "date")),
)
#: Words that ask for a comparison with normals.
DEPARTURES = ("departure", "departures", "deviation", "anomaly", "anomalies")


def _words(text: str) -> list[str]:
    return [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in re.findall("[a-z0-9_]+", text.lower())]


#: Words that name nothing in a table.
SILENT = FILLER | {w for _, names in AGGREGATE_WORDS for n in names for w in n.split()} | set("tell much last first value there highest lowest than least most".split())


def telling(text: str) -> list[str]:
    """The words of a text that may name something, in the singular."""
    return [w for w in dict.fromkeys(_words(text.replace("_", " "))) if w not in SILENT]


def spellings(text: str) -> list[str]:
    """All words of a text, as written and in the singular, and the present names of places."""
    said = {*re.findall("[a-z0-9]+", text.lower()), *(p for w in _words(text) for p in w.split("_"))}
    return sorted(said | {FORMER_NAMES[w] for w in said if w in FORMER_NAMES})


def synonyms(name: str) -> tuple[str, ...]:
    """Phrases that mean a measure with this column name."""
    return tuple(s for part, more in SYNONYMS.items() if part in name or part.replace("_", "") in name for s in more)


def likeness(word: str, name: str) -> float:
    """0 to 1 for words that begin with the same letters, otherwise 0."""
    word, name = word.lower(), name.lower()
    if len(word) < FIRST_LETTERS or word[:FIRST_LETTERS] != name[:FIRST_LETTERS]:
        return 0.0
    return SequenceMatcher(None, word, name).ratio()


def _stem(a: str, b: str) -> bool:
    return len(a) >= STEM and len(b) >= STEM and a[:STEM] == b[:STEM]


def parse_time(text: str, today: dt.date | None = None) -> tuple[TimeSpec, str]:
    """The months and years that a question names, and the rest of it; the longest name of a season counts."""
    rest, months, label = text.lower(), (), []
    for name in sorted(SEASON_NAMES, key=len, reverse=True):
        if m := re.search(rf"\b{re.escape(name)}\b", rest):
            months, rest = SEASONS[SEASON_NAMES[name]], rest[: m.start()] + " " + rest[m.end() :]
            label.append(SEASON_NAMES[name])
            break
    if not months:
        found = [(m.start(), m.end(), k) for k, n in enumerate(MONTHS, 1) for m in re.finditer(rf"\b({n}|{n[:3]})\b", rest)]
        # "may" is a month only after a preposition or alone with others
        found = [f for f in found if f[2] != 5 or re.search(r"\b(in|of|for|during|and|to)\s*$", rest[: f[0]])]
        months = tuple(sorted({k for _, _, k in found}))
        for a, b, _ in sorted(found, reverse=True):
            rest = rest[:a] + " " * (b - a) + rest[b:]
        label += [MONTHS[k - 1].title() for k in months]
    years, low, high = (), None, None
    if m := re.search(r"\blast\s+(\d{1,3})\s+(day|month|year)s?\b", rest):
        if m[2] != "year":
            raise Unanswerable("a span of days or months counted back from today cannot be applied to these tables")
        high = (today or dt.date.today()).year
        low = high - int(m[1]) + 1
        label.append(f"last {m[1]} years")
    elif m := re.search(YEAR_RANGE, rest):
        low, high = sorted(int(x) for x in m.groups())
        label.append(f"{low} to {high}")
    if m:
        rest = rest[: m.start()] + " " + rest[m.end() :]
    else:
        years = tuple(sorted({int(y) for y in re.findall(rf"\b({YEAR})\b", rest)}))
        rest = re.sub(rf"\b{YEAR}\b", " ", rest)
        label += [str(y) for y in years]
    return TimeSpec(tuple(months), years, low, high, ", ".join(label)), re.sub(r"\s+", " ", rest).strip()


class Listed:
    """The values of tables' columns, held as lists: table -> column -> values."""

    def __init__(self, values: dict[str, dict[str, tuple[str, ...]]]):
        self.values = values

    def named(self, table: str, words: set[str]) -> dict[str, tuple[str, ...]]:
        """By column, the values all of whose words are given."""
        return {c: got for c, known in self.values.get(table, {}).items() if (got := tuple(v for v in known if (w := set(_words(v))) and w <= words))}

    def near(self, table: str, words: list[str]) -> dict[str, list[tuple[str, str]]]:
        """By word, the few (column, value) that are spelt nearly so, the nearest first."""
        out = {}
        for word in words:
            alike = sorted(((likeness(word, v), c, v) for c, known in self.values.get(table, {}).items() for v in known), key=lambda x: (-x[0], x[1], x[2]))
            if got := [(c, v) for x, c, v in alike[:RESCUED] if x >= ALIKE]:
                out[word] = got
        return out


class Asker:
    """Answers questions over named tables: name -> (DataFrame or what opens it, its columns).

    ``values`` are lists, or anything that looks values up as ``Listed`` does.
    ``normals`` are names of tables that hold normals; they are compared with and
    answer no question by themselves where another table can.
    """

    def __init__(self, tables: dict[str, tuple[DataFrame | Callable[[], DataFrame], tuple[Column, ...]]], values: dict[str, dict[str, tuple[str, ...]]] | Listed | None = None, normals: tuple[str, ...] = ()):
        self.tables, self.values, self.normals = tables, values if hasattr(values, "near") else Listed(values or {}), normals

    def resolve(self, question: str, hint: str | None = None) -> tuple[str, Plan]:
        if not 2 <= len(question) <= 500:
            raise Unanswerable("a question has 2 to 500 characters")
        time, rest = parse_time(question)
        limit, descending = None, True
        if m := re.search(r"\b(top|first|highest|bottom|lowest)\s+(\d{1,4})\b", rest):
            limit, descending = int(m[2]), m[1] not in ("bottom", "lowest")
            rest = rest[: m.start()] + " " + rest[m.end() :]
        elif re.search(rf"\b({'|'.join(ASCENDING_WORDS)})\b", re.sub(r"\bat least\b", " ", rest)):
            descending = False
        compared = bool(re.search(rf"\b(?:{'|'.join(DEPARTURES)})\b", rest))
        if compared:
            rest = re.sub(rf"\b(?:{'|'.join(DEPARTURES)})\b(?:\s+(?:of|from|in))*(?:\s+normals?\b)?|\bfrom\s+(?:the\s+)?normals?\b", " ", rest)
        filters, number = [], r"(-?\d+(?:\.\d+)?)"
        for op, names in COMPARISONS:
            for n in names:
                if m := re.search(rf"(?:\b|(?<=\s)){re.escape(n)}\s*{number}", rest):
                    filters.append((op, float(m[1])))
                    rest = rest[: m.start()] + " " + rest[m.end() :]
        aggregation = None
        for kind, names in AGGREGATE_WORDS:
            hit = next((n for n in names if re.search(rf"\b{n}\b", rest)), None)
            if hit and aggregation is None:
                aggregation = kind
                said = hit
        target = re.sub(rf"\b{said}\b", " ", rest, count=1) if aggregation else rest
        before, _, after = target.partition(" by ")
        after = after.strip()
        best: list[tuple[float, str, Column]] = []
        notes: list[str] = []
        heard = set(_words(rest))
        for name, (_, columns) in self.tables.items():
            if hint and name != hint or compared and name in self.normals:
                continue
            asked = set(_words(before)) | ({w for w in _words(after)} if limit else set())
            for c in columns:
                terms = set(_words(" ".join(c.terms)))
                both = len(asked & terms) + max((len(p) for x in c.also if (p := set(_words(x)) - terms) and p <= asked | terms and p & asked), default=0)
                if c.role == "measure" and both:
                    # a sheet or file that is named in full, beyond the words of the measure, settles which one is meant
                    told = any((w := set(_words(p.replace("_", " ")))) and w <= heard and not w <= terms for p in c.places)
                    best.append((both + 2.0 * (terms <= asked) + 0.5 * (name.rstrip("s") in asked) + told, name, c))
        if not best:
            best, word = self._rescue_measure(_words(before), hint)
            if best:
                notes.append(f"No measure is spelt '{word}'; {best[0][2].label or best[0][2].name} comes nearest.")
        if not best:
            raise Unanswerable("nothing in the tables goes by what is asked for")
        best.sort(key=lambda x: (-x[0], x[1], x[2].name))
        if not hint and len(best) > 1 and best[1][1:] != best[0][1:] and best[1][0] >= best[0][0] * 0.88:
            raise AmbiguousQuery("the question fits more than one column; name its table", candidates=[{"table": t, "column": c.name} for _, t, c in best[:4]])
        _, table, measure = best[0]
        columns = self.tables[table][1]
        groups = ()
        for side in (after, before):
            asked = _words(side)
            hits = [c.name for c in columns if c.role not in ("measure", "date") and set(_words(" ".join(c.terms))) <= set(asked)]
            if hits and (side == after or limit):
                groups = tuple(hits)
                break
        if aggregation is None:
            averaged = measure.unit in AVERAGED_UNITS or any(w in measure.name for w in AVERAGED_NAMES)
            aggregation = "avg" if averaged else "sum"
        where = [Filter(measure.name, op, (v,)) for op, v in filters]
        by_name = {c.name: c for c in columns}
        accounted = {w for c in (measure, *(by_name[g] for g in groups)) for w in _words(" ".join((*c.terms, c.label, c.name.replace("_", " "), *(p.replace("_", " ") for p in c.places))))}
        found, guessed = self._values(table, _words(rest), accounted)
        whole = getattr(self.values, "complete", False) and not guessed  # all spellings of these values are known
        where += [Filter(column, "=", named, named if whole else ()) for column, named in found.items()]
        notes += guessed
        for column, named in found.items():
            accounted |= {w for v in (*named, column.replace("_", " ")) for w in (*_words(v), *(o for o, n in FORMER_NAMES.items() if n in _words(v)))}
        left = [w for w in _words(rest) if w not in SILENT and not w.isdigit()]
        if not notes and any(w not in accounted and not any(_stem(w, a) for a in accounted) for w in left):
            notes.append(f"Nothing is known of '{' '.join(left)}'; the answer is about {measure.label or measure.name}.")
        times = {c.name for c in columns if c.role == "time"}
        intent = "ranking" if limit and groups else "trend" if groups and set(groups) <= times else "breakdown" if groups else "aggregate"
        plan = Plan(intent, measure.name, aggregation, groups, tuple(where), time, descending, limit if limit and groups else 5000)
        date = next((c.name for c in columns if c.role == "date"), None)
        return table, replace(plan, notes=tuple(notes), date=date, normals=self._normals(table, measure, groups, found) if compared else None)

    def _normals(self, table: str, measure: Column, groups: tuple[str, ...], values: dict[str, tuple[str, ...]]) -> Normals:
        """The first table of normals that has the measure, compared by all groups that it has too."""
        said = set(_words(" ".join(measure.terms)))
        for name in self.normals:
            columns = self.tables[name][1]
            if hit := next((c for c in columns if c.role == "measure" and said & set(_words(" ".join(c.terms)))), None):
                have = {c.name for c in columns if c.role != "measure"}
                if set(values) - set(groups):
                    raise Unanswerable("a departure is asked for by the columns whose values it is about; group by them")
                return Normals(name, hit.name, tuple(g for g in groups if g in have))
        raise Unanswerable(f"no table holds normals of {measure.label or measure.name}")

    def _rescue_measure(self, words: list[str], hint: str | None) -> tuple[list[tuple[float, str, Column]], str]:
        """Measures whose name a word of the question nearly spells or begins, the likest first, and that word."""
        for word in (w for w in words if w not in SILENT):
            got = []
            for name, (_, columns) in self.tables.items():
                for c in columns if not hint or name == hint else ():
                    spelt = [c.label or c.name, *c.terms, *c.also]
                    near = max(max(likeness(word, x) for x in spelt), float(any(len(x) >= STEM and word.startswith(x) for x in map(str.lower, spelt))))
                    if c.role == "measure" and near >= ALIKE:
                        got.append((near, name, c))
            if got:
                return got, word
        return [], ""

    def _values(self, table: str, asked: list[str], accounted: set[str]) -> tuple[dict[str, tuple[str, ...]], list[str]]:
        """The values a question names, by column, under their own or a former name; if none, those of the nearest spelling."""
        now = set(asked) | {FORMER_NAMES[w] for w in asked if w in FORMER_NAMES}
        found = self.values.named(table, now)
        if found:
            return self._one_reading(table, found, asked), []
        doubtful = [w for w in asked if len(w) >= 4 and w not in SILENT and w not in accounted]
        near = self.values.near(table, doubtful) if doubtful else {}
        word = next((w for w in doubtful if near.get(w)), None)
        if word is None:
            return {}, []
        for c, v in near[word]:
            found.setdefault(c, (v,))
        return found, [f"No value is spelt '{word}'; {near[word][0][1]} comes nearest."]

    def _one_reading(self, table: str, found: dict[str, tuple[str, ...]], asked: list[str]) -> dict[str, tuple[str, ...]]:
        """A value of several columns filters the one that the question names; if it names none or several, the question is open."""
        named = {c.name for c in self.tables[table][1] if set(_words(" ".join(c.terms))) & set(asked)}
        places: dict[str, list[str]] = {}
        for c, values in found.items():
            for v in values:
                places.setdefault(v.lower(), []).append(c)
        for value, columns in places.items():
            if len(columns) > 1:
                meant = [c for c in columns if c in named]
                if len(meant) != 1:
                    raise AmbiguousQuery(f"'{value}' stands in more than one column; name the column", candidates=[{"table": table, "column": c, "value": value} for c in columns[:4]])
                for c in columns:
                    if c != meant[0]:
                        found[c] = tuple(v for v in found[c] if v.lower() != value)
        return {c: v for c, v in found.items() if v}

    def rows(self, question: str, hint: str | None = None) -> DataFrame:
        table, plan = self.resolve(question, hint)
        return compile_plan(self.open(table), plan, plan.normals and self.open(plan.normals.table))

    def open(self, table: str) -> DataFrame:
        df = self.tables[table][0]
        return df() if callable(df) else df

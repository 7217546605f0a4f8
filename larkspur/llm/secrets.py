"""Secret scans: fixed patterns, and character Markov models for the rest.

Base spans come from three patterns.  Every other run of at least ``SHORTEST``
key characters, with base spans cut out of the text first, is scored by
first-order Markov models over its characters: of random strings, one a kind of
alphabet, and of ordinary identifiers, one a kind of identifier.  It is reported
as ``markov`` if the log-likelihood ratio of the likeliest random model to the
likeliest ordinary one reaches ``threshold`` for each pair of characters and
``total`` in all, which asks more of a short run.

All models are trained on labelled samples.  Random: ``RANDOM_ROWS`` strings
each in base64, base62 and base32 made from SHA-256 digests.  Ordinary: words
and names made of neighbouring words (snake and camel case, paths, versions),
names in capitals, UUIDs, and numbers and times.  The words are those of at most
``SAMPLE_DOCS`` documents (the smallest hashed ids) and ``NAMES``.  A pair that a
model has not seen falls back on how often its kind has the second character.
A model is a table of 68 x 68 numbers whatever the corpus, so it travels as a
literal.  What is made like a UUID, a time or a number is never reported, though
it may be a key.

Defined cases: a null text counts as empty and has no span; a long text is
scanned whole; repeated rows, also of equal or null ids, are scanned each; other
columns are ignored by ``scan`` and kept by ``redact``; with an empty table the
words are those of ``NAMES`` alone, and the result is empty.  Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, settle, sums_before, text_of, words_of

# Fixed patterns: what each kind of base span is.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 12, "access": 18, "hex": 16}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SHORTEST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Log-likelihood ratio, in nats: for each pair of characters, and in all.
THRESHOLD, TOTAL = 0.9, 16.0
#: Weight, in pairs, of a kind's own letter frequencies where it has seen few pairs that begin with a letter.
PRIOR = 4.0
RANDOM_ROWS = 2000
SAMPLE_DOCS = 2000


def _pairs(strings: DataFrame, label: str) -> DataFrame:
    """Counts of neighbouring characters in a one-column frame of strings."""
    s = strings.select(strings[0].alias("s")).where("char_length(s) > 1")
    two = s.select(F.explode(F.expr("transform(sequence(1, char_length(s) - 1), i -> substring(s, i, 2))")).alias("two"))
    two = two.where(F.col("two").rlike(r"^[A-Za-z0-9+/_=.-]{2}$"))
    return two.groupBy("two").count().select(F.lit(label).alias("label"), "two", "count")


# Words that names in programs and paths are made of.
NAMES = (
    "access account action address admin application archive array async authentication auto backup base batch binary block boot branch buffer build bundle cache call catalog channel check class client cloud cluster code collection color column command "
    "common component config connection constant container content context control core count create current data database date debug default delete desktop device directory display document domain download driver dynamic enable encoding engine entry "
    "environment error event example exception export extension factory feature field file filter format frame function global group handler hash header home host http icon image import index input instance international item java job json kernel key "
    "label language layout length level library license limit list load local lock log machine main manager map master memory message method model module network node number object option order output package page parameter parser path pattern plugin "
    "policy port private process profile project property proxy public python query queue range read region release report request resource response result retry root route runtime schema script search security server service session setting share site "
    "size source space stack start state storage stream string system table target task template temp test text thread time timeout tool total type"
).split()


def random_strings(spark: SparkSession, first: int = 0, rows: int = RANDOM_ROWS) -> DataFrame:
    """Labelled random strings of digests: base64, plain and for file names, and base62."""
    b64 = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    return spark.range(first, first + rows, 1, 4).select(F.explode(F.array(F.translate(b64, "=", ""), F.translate(b64, "+/=", "-_"), F.regexp_replace(b64, "[^A-Za-z0-9]", ""))).alias("s"))


def random_capitals(spark: SparkSession, first: int = 0, rows: int = RANDOM_ROWS) -> DataFrame:
    """Labelled random strings of capitals and digits."""
    return spark.range(first, first + rows, 1, 4).select(F.translate(F.sha2(F.col("id").cast("string"), 512), "0123456789abcdef", "A2B3C4D5E6F7GHIJ").alias("s")).unionAll(
        spark.range(first, first + rows, 1, 4).select(F.regexp_replace(F.upper(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 384)))), "[^A-Z0-9]", "").alias("s"))
    )


_THREE = "transform(sequence(0, (size(p) - 3) div 3), i -> {})"
_A, _B, _C = (f"lower(p[3 * i + {k}])" for k in range(3))
NAMES_MADE = (
    f"concat({_A}, '_', {_B}, '_', {_C})", f"concat({_A}, initcap({_B}), initcap({_C}))", f"concat('/', {_A}, '/', {_B}, '/', {_C})", f"concat('/', {_A}, i % 10, '/', {_B}, '-', {_C}, '/')",
    f"concat({_A}, '-', {_B}, '-v', i % 10, '_', i % 7, '_', i % 100)",
)
CAPITALS_MADE = (f"upper(concat({_A}, '_', {_B}, '_', {_C}))", f"upper({_A})", f"upper(concat({_A}, '_', {_B}, '_', i % 100))", f"upper(concat({_B}, '-', {_C}))")


def _made(words: DataFrame, forms: tuple[str, ...], plain: bool) -> DataFrame:
    """Names made of each three neighbouring words of the arrays ``w`` and, with ``plain``, the words themselves."""
    d = words.select("w", F.filter(F.transform("w", lambda x: F.regexp_replace(x, "[^A-Za-z]", "")), lambda x: F.char_length(x) > 1).alias("p"))
    made = [F.when(F.expr("size(p) >= 3"), F.expr(_THREE.format(x))).otherwise(F.array().cast("array<string>")) for x in forms]
    return d.select(F.explode(F.concat(*([F.col("w")] if plain else []), *made)).alias("s"))


def identifiers(words: DataFrame) -> DataFrame:
    """Labelled identifiers, from a frame with an array ``w`` of a text's words: the words, and names made of neighbours."""
    return _made(words, NAMES_MADE, True)


def capitals(words: DataFrame) -> DataFrame:
    """Labelled identifiers in capitals."""
    return _made(words, CAPITALS_MADE, False)


def uuids(spark: SparkSession, first: int = 0, rows: int = RANDOM_ROWS) -> DataFrame:
    h = spark.range(first, first + rows, 1, 4).select(F.sha2(F.concat(F.lit("uuid"), F.col("id").cast("string")), 256).alias("h"))
    return h.select(F.concat_ws("-", *[F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("s"))


def numbers(spark: SparkSession, first: int = 0, rows: int = RANDOM_ROWS) -> DataFrame:
    """Labelled numbers and times."""
    d = spark.range(first, first + rows, 1, 4).select(F.abs(F.xxhash64("id")).alias("n"), F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2_000_000_000))).alias("t"))
    forms = [F.lpad(F.col("n").cast("string"), 19, "7"), F.concat_ws("-", *[F.substring(F.col("n").cast("string"), a, 4) for a in (1, 5, 9, 13)]), F.concat_ws("/", *[F.substring(F.col("n").cast("string"), a, 3) for a in (2, 5, 8, 11)])]
    forms += [F.date_format("t", x) for x in ("yyyy-MM-dd'T'HH-mm-ss", "yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd'T'HHmmss+0000", "yyyy/MM/dd/HH/mm/ss", "yyyy-MM-dd_HH-mm-ss", "yyyyMMddHHmmssSSS")]
    return d.select(F.explode(F.array(*forms)).alias("s"))


def labelled(spark: SparkSession, docs: DataFrame) -> dict[str, DataFrame]:
    """Samples of each kind of random strings and of ordinary identifiers."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    said = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select(text_of().alias("text"))
    turns = [" ".join(NAMES[k:] + NAMES[:k]) for k in range(3)] + [" ".join(NAMES[k::7]) for k in range(7)]
    words = settle(said.unionAll(spark.createDataFrame([(t,) for t in turns * 3], "text string")), words_of(F.col("text")).alias("w"))
    # words that carry a secret would teach the wrong class
    clean = ~F.col("s").rlike(r"[0-9a-f]{16}|AKIA|[0-9].*[A-Za-z].*[0-9].*[A-Za-z]")
    return {
        "random": random_strings(spark), "random_capitals": random_capitals(spark),
        "names": identifiers(words).where(clean), "capitals": capitals(words).where(clean), "uuids": uuids(spark), "numbers": numbers(spark),
    }


def train(docs: DataFrame) -> dict[str, list[float]]:
    """For each kind the logarithms of its transition probabilities, row by row of ALPHABET."""
    samples = labelled(docs.sparkSession, docs)
    n = len(ALPHABET)
    seen = {k: [[0] * n for _ in range(n)] for k in samples}
    for label, two, c in reduce(DataFrame.unionAll, [_pairs(d, k) for k, d in samples.items()]).collect():  # 6 * 68 * 68 rows at most
        seen[label][ALPHABET.index(two[0])][ALPHABET.index(two[1])] += c
    out = {}
    for k, rows in seen.items():
        often = [sum(r[b] for r in rows) + 0.5 for b in range(n)]
        usual = [x / sum(often) for x in often]
        out[k] = [log((r[b] + PRIOR * usual[b]) / (sum(r) + PRIOR)) for r in rows for b in range(n)]
    return out


def ratio(s: str, tables: dict[str, list[float]]) -> str:
    """SQL: the log-likelihood ratio of string expression ``s``: the likeliest random kind to the likeliest ordinary one."""
    n = len(ALPHABET)
    cells = f"transform(split({s}, ''), c -> instr('{ALPHABET}', c) - 1)"
    steps = f"transform(sequence(0, size(t) - 2), i -> t[i] * {n} + t[i + 1])"
    kinds = {k: f"aggregate(j, 0D, (a, x) -> a + coalesce(get(array({', '.join(f'{v:.5g}D' for v in table)}), x), 0D))" for k, table in tables.items()}
    best = [f"greatest({', '.join(v for k, v in kinds.items() if k.startswith('random') == is_random)})" for is_random in (True, False)]
    return f"element_at(transform(transform(array({cells}), t -> {steps}), j -> {best[0]} - {best[1]}), 1)"


def random_looking(s: str, tables: dict[str, list[float]], threshold: float = THRESHOLD, total: float = TOTAL) -> str:
    """SQL: does string expression ``s`` look random?  The models decide, nothing else."""
    return f"exists(array({ratio(s, tables)}), r -> r >= {total} and r >= {threshold} * (char_length({s}) - 1))"


def _located(d: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Replaces each array ``m_<kind>`` of matched strings by ``p_<kind>``: struct(start, end, text).

    A text's pieces around the matches have the lengths that are missing.
    """
    rest = [c for c in d.columns if not c.startswith("m_")]
    for kind, pattern in kinds.items():
        d = d.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)))
    d = settle(d, *d.columns)
    steps = {k: f"zip_with(slice(g_{k}, 1, size(m_{k})), m_{k}, (g, m) -> char_length(g) + char_length(m))" for k in kinds}
    d = settle(d, *d.columns, *[F.expr(f"case when size(m_{k}) > 0 then {s} end").alias(f"l_{k}") for k, s in steps.items()])
    d = settle(d, *d.columns, *[F.expr(f"case when size(m_{k}) > 0 then {sums_before(f'l_{k}')} end").alias(f"b_{k}") for k in kinds])
    out = [
        F.expr(
            f"case when size(m_{k}) > 0 then transform(m_{k}, (m, i) -> named_struct('start', b_{k}[i] + char_length(g_{k}[i]), "
            f"'end', b_{k}[i] + l_{k}[i], 'text', m)) else cast(array() as array<struct<start:int,end:int,text:string>>) end"
        ).alias(f"p_{k}")
        for k in kinds
    ]
    return settle(d, *rest, *out)


def _without(text: str, kind: str, kept: str) -> str:
    """SQL: ``text`` with blanks in place of the matches x of ``kind`` for which ``kept`` holds; its length stays."""
    pieces = f"zip_with(slice(g_{kind}, 1, size(m_{kind})), m_{kind}, (g, x) -> concat(g, case when {kept} then repeat(' ', char_length(x)) else x end))"
    return f"case when size(m_{kind}) > 0 then concat(array_join({pieces}, ''), element_at(g_{kind}, -1)) else {text} end"


def scan(docs: DataFrame, threshold: float = THRESHOLD, total: float = TOTAL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: array of struct(start, no, end, kind), by start, then kind as listed."""
    tables = train(docs)
    text = F.col("text")
    none = F.array().cast("array<string>")
    d = docs.select(*keep, text_of().alias("text"))
    mark = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    d = settle(
        d, *keep, "text",
        F.when(mark, F.regexp_extract_all(text, F.lit(ASSIGN), 0)).otherwise(none).alias("m_assign"),
        F.when(mark, F.regexp_extract_all(text, F.lit(ASSIGN), 1)).otherwise(none).alias("v"),
        F.when(F.contains(text, F.lit("AKIA")), F.regexp_extract_all(text, F.lit(ACCESS), 0)).otherwise(none).alias("m_access"),
        F.regexp_extract_all(text, F.lit(HEX), 0).alias("m_hex"),
    )
    d = _located(d, {"assign": ASSIGN, "access": ACCESS, "hex": HEX})
    made = {k: f"transform(p_{k}, x -> named_struct('start', x.start, 'no', {no}, 'end', x.end, 'kind', '{k}'))" for no, k in enumerate(KINDS)}
    good = {
        "assign": f"transform(filter(arrays_zip(p_assign, v), x -> char_length(x.v) >= {LEAST['assign']}), x -> named_struct('start', x.p_assign.start, 'no', 0, 'end', x.p_assign.end, 'kind', 'assign'))",
        "access": f"filter({made['access']}, x -> x.end - x.start >= {LEAST['access']})",
        "hex": made["hex"],
    }
    d = settle(d, *keep, "text", F.expr(f"sort_array(concat({', '.join(good.values())}))").alias("base"))
    # base spans are cut out kind by kind, so that the rest of a run around one is scored as well
    for kind, pattern in {"assign": ASSIGN, "access": ACCESS, "hex": HEX}.items():
        matched = F.when(F.exists("base", lambda x: x["kind"] == kind), F.regexp_extract_all(F.col("text"), F.lit(pattern), 0)).otherwise(none)
        d = settle(d, *keep, "base", "text", matched.alias(f"m_{kind}"))
        d = settle(d, *keep, "base", "text", f"m_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).alias(f"g_{kind}"))
        long = f"char_length(regexp_extract(x, '{_sql(ASSIGN)}', 1)) >= {LEAST['assign']}" if kind == "assign" else f"char_length(x) >= {LEAST[kind]}"
        d = settle(d, *keep, "base", F.expr(_without("text", kind, long)).alias("text"))
    d = settle(d, *keep, "base", "text", F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("m_markov"))
    d = _located(d, {"markov": CANDIDATE})
    more = f"transform(filter(p_markov, x -> {random_looking('x.text', tables, threshold, total)}), x -> named_struct('start', x.start, 'no', 3, 'end', x.end, 'kind', 'markov'))"
    spans = F.expr(f"case when size(p_markov) > 0 then sort_array(concat(base, {more})) else base end")
    return settle(d, *keep, "base", spans.alias("spans"))


def _sql(pattern: str) -> str:
    """A pattern inside an SQL string."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def query(docs: DataFrame) -> DataFrame:
    d = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return settle(d, "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of a text, overlaps merged, replaced by ``mask``."""
    cols = docs.columns
    body, row = free_name(docs, "scanned_text"), free_name(docs, "whole_row")
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in cols]).alias(row))
    d = scan(packed, keep=("doc_id", row)).withColumn(body, F.coalesce(F.col(f"{row}.text"), F.lit("")))
    # runs of overlapping spans are one; the text between them is cut from one to the next
    merged = (
        "aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (a, x) -> case when size(a) > 0 and x.start < a[size(a) - 1].end "
        "then concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))) else concat(a, array(named_struct('start', x.start, 'end', x.end))) end)"
    )
    d = settle(d, row, body, "spans", F.expr(merged).alias("gaps"))
    cut = (
        f"concat(array_join(transform(gaps, (x, i) -> concat(substring({body}, case when i = 0 then 1 else gaps[i - 1].end + 1 end, x.start - case when i = 0 then 0 else gaps[i - 1].end end), '{mask}')), ''), "
        f"substring({body}, element_at(gaps, -1).end + 1))"
    )
    text = F.expr(f"case when size(spans) > 0 then {cut} else {row}.text end")
    d = settle(d, row, text.alias(body))
    values = []
    for c in cols:
        if c == "text":
            values.append(F.col(body).alias(c))
        elif c == "n_chars":  # stays the number of code points where it was
            values.append(F.when(F.col(f"{row}.n_chars").isNotNull(), F.char_length(F.coalesce(body, F.lit("")))).cast(docs.schema[c].dataType).alias(c))
        else:
            values.append(F.col(row)[c].alias(c))
    return d.select(*values)

"""License scans: MinHash bands over overlapping windows of a text retrieve templates.

Words are runs of ASCII letters and digits, A-Z as a-z; a shingle is five of
them.  A template of m shingles is looked for in windows of w shingles, w the
least power of two from 2m on, begun every w/2: so each stretch of m shingles
lies whole in a window.  A window and a template are a candidate pair if one of
``BANDS`` minhashes is the same.  At a containment of 0.8 their Jaccard
similarity is at least 0.8m / (w + 0.2m) > 0.19, and a pair is missed with a
probability below 0.81**64 = 1.4e-6.  A match needs at least ``num / den`` of
the template's distinct shingles in the window, counted exactly.  Notices of
sister licenses differ in few words, so one may be found in the words of another:
where matches of two licenses overlap, the one whose found shingles are a part of
the other's is left out, and of two with the same the one of less containment.
Words that do not tell two licenses apart (same shingles, same containment) give both.

Only windows that hold a shingle which is some template's minimum can collide,
so no others are built; nothing is lost by that.  All of it is done inside the
row: no shuffle, no driver work but on the templates, whose number is bounded
by ``MOST_TEMPLATES``.

Defined cases: a null text counts as empty; a text of fewer than five words has
no shingle and no match; rows repeat as they come; equal matches of one row are
given once; a template of fewer than five words is refused; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, text_of
from .notices import MORE

SHINGLE = 5
BANDS = 64
MOST_TEMPLATES = 1000
NUM, DEN = 80, 100

# Notices of public licenses, as their publishers word them; ``EVERY`` has those of other versions and families too.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
EVERY = list(dict.fromkeys(TEMPLATES + MORE))


def shingled(d: DataFrame, *keys: str) -> DataFrame:
    """keys and ``sh``: hashes of the shingles of ``text``, in their order."""
    low = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = settle(d, *keys, F.array_remove(F.split(low, "[^a-z0-9]+", -1), "").alias("words"))
    d = settle(d, *keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    five = ", ".join(f"h[i + {k}]" for k in range(SHINGLE))
    return settle(d, *keys, F.expr(f"case when size(h) >= {SHINGLE} then transform(sequence(0, size(h) - {SHINGLE}), i -> xxhash64({five})) else cast(array() as array<bigint>) end").alias("sh"))


def _bands(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, i))))


def compiled(spark: SparkSession, templates: list[tuple[str, str]]) -> list[dict]:
    """Each template's shingles, bands, window width and the shingles that are a minimum."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    d = shingled(spark.createDataFrame(list(templates), "license string, text string"), "license", "text")
    least = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.array_min(F.transform("sh", lambda s: F.struct(F.xxhash64(s, i).alias("v"), s.alias("s"))))["s"])
    out = []
    for r in d.select("license", "text", F.size("sh").alias("m"), F.array_distinct("sh").alias("sh"), _bands(F.col("sh")).alias("bands"), F.array_distinct(least).alias("least")).collect():
        if not r.m:
            raise ValueError(f"a template needs {SHINGLE} words: {r.text!r}")
        out.append({**r.asDict(), "w": width(r.m)})
    return out


def width(m: int) -> int:
    """Shingles of a window for a template of ``m`` shingles."""
    return 1 << (2 * m - 1).bit_length()


def _longs(numbers: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _told_apart(matches: Column) -> Column:
    """The matches that no match of another license on the same words explains better."""

    def better(a: Column, b: Column) -> Column:
        other = (a["license"] != b["license"]) & (a["first_word"] < b["past_word"]) & (b["first_word"] < a["past_word"])
        more = (F.size(b["sh"]) > F.size(a["sh"])) | ((F.size(b["sh"]) == F.size(a["sh"])) & (b["containment"] > a["containment"]))
        return other & more & (F.size(F.array_except(a["sh"], b["sh"])) == 0)

    return F.filter(matches, lambda a: ~F.exists(matches, lambda b: better(a, b)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = EVERY, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_words and ``matches``: structs of license, containment, first and past-last word."""
    known = compiled(docs.sparkSession, templates)
    d = shingled(docs.select("doc_id", "text"), "doc_id")
    windows = "array<struct<w:int,at:int,sh:array<bigint>>>"
    per_width = []
    for w in sorted({t["w"] for t in known}):
        step, minima = w // 2, sorted({s for t in known if t["w"] == w for s in t["least"]})
        hits = F.array_compact(F.transform("sh", lambda s, i: F.when(s.isin(minima), i)))
        no = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array((p / step).cast("int") - 1, (p / step).cast("int")))))
        cut = lambda k: F.struct(F.lit(w).alias("w"), (k * step).cast("int").alias("at"), F.slice("sh", k * step + 1, F.lit(w)).alias("sh"))
        per_width.append(F.transform(F.filter(no, lambda k: k >= 0), cut).cast(windows))
    every = sorted({s for t in known for s in t["least"]})
    n = F.when(F.size("sh") > 0, F.size("sh") + SHINGLE - 1).otherwise(0).cast("long").alias("n_shingled_words")
    d = settle(d, "doc_id", n, F.when(F.exists("sh", lambda s: s.isin(every)), F.concat(*per_width)).otherwise(F.array().cast(windows)).alias("windows"))
    banded = lambda x: F.struct(x["w"].alias("w"), x["at"].alias("at"), x["sh"].alias("sh"), _bands(x["sh"]).alias("bands"))
    d = settle(d, "doc_id", "n_shingled_words", F.transform("windows", banded).alias("windows"))
    shelf = F.array(*[F.struct(F.lit(t["license"]).alias("license"), F.lit(t["w"]).alias("w"), _longs(t["sh"]).alias("sh"), _longs(t["bands"]).alias("bands")) for t in known])

    def found(x: Column) -> Column:
        near = F.filter(shelf, lambda t: (t["w"] == x["w"]) & F.arrays_overlap(t["bands"], x["bands"]))
        whole = F.filter(near, lambda t: F.size(F.array_intersect(t["sh"], x["sh"])) * den >= F.size(t["sh"]) * num)
        spots = lambda t: F.array_compact(F.transform(x["sh"], lambda s, i: F.when(F.array_contains(t["sh"], s), i)))
        return F.transform(whole, lambda t: F.struct(
            t["license"].alias("license"), (F.size(F.array_intersect(t["sh"], x["sh"])) / F.size(t["sh"])).alias("containment"),
            (x["at"] + F.array_min(spots(t))).alias("first_word"), (x["at"] + F.array_max(spots(t)) + SHINGLE).alias("past_word"),
            F.array_intersect(t["sh"], x["sh"]).alias("sh"),
        ))

    d = settle(d, "doc_id", "n_shingled_words", F.array_distinct(F.flatten(F.transform("windows", found))).alias("matches"))
    bare = lambda m: F.struct(*[m[c].alias(c) for c in ("license", "containment", "first_word", "past_word")])
    return settle(d, "doc_id", "n_shingled_words", F.array_sort(F.array_distinct(F.transform(_told_apart(F.col("matches")), bare))).alias("matches"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (comma-joined, in order), containment (the best; 0 if none)."""
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return scan(docs).select(
        "doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("containment"),
    )


def _oracle() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(k, *(x.replace("'", "''") for x in t)) for k, t in enumerate(TEMPLATES))
    words = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    cut = "select {0}, p - 1 as p, array_to_string(t[p:p+4], ' ') as g from (select {0}, t, unnest(range(1, len(t) - 3)) as p from {1} where len(t) >= 5)"
    return f"""
with template(k, license, body) as (values {rows}),
tw as (select k, {words.format("body")} as t from template),
ts as ({cut.format("k", "tw")}),
size as (select k, count(distinct g) as n, cast(pow(2, ceil(log2(2 * count(*)))) as bigint) as w from ts group by k),
dw as (select doc_id, {words.format("text")} as t from documents),
ds as ({cut.format("doc_id", "dw")}),
hit as (select d.doc_id, s.k, s.n, d.p // (s.w // 2) as b, d.g from ds d join (select distinct k, g from ts) x on x.g = d.g join size s on s.k = x.k),
wins as (select doc_id, k, n, b, g from hit union all select doc_id, k, n, b - 1, g from hit where b > 0),
got as (select doc_id, k, n, b, count(distinct g) as c from wins group by all having 100 * count(distinct g) >= 80 * n),
best as (select g.doc_id, string_agg(distinct t.license, ',' order by t.license) as l, count(distinct t.license) as m, max(cast(c as double) / n) as containment from got g join template t on t.k = g.k group by 1)
select d.doc_id, cast(coalesce(m, 0) as bigint) as n_licenses, coalesce(l, '') as licenses, coalesce(containment, 0.0::double) as containment from documents d left join best using (doc_id)
"""


ORACLE = _oracle()

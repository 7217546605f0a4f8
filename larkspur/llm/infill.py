"""Fill-in-the-middle: a text is cut in three and its middle moved to the end.

A text is cut only at the ends of units, which a pattern of the ``regex``
library finds from left to right (single code points unless told otherwise;
what no unit matches goes with the unit that follows it, or with the suffix).
The ends lie in a compact array, so each of the two cuts is one look-up,
whatever the text's length.  Where to cut and which form to take come from a
SHA-256 of the document's id: a rerun gives the same rows on any cluster, and no
state or shuffle is needed.

Defined cases: a null text counts as empty; an empty text, and one that holds a
mark, stay plain; a null id has the seed of an empty id; very long texts take
four bytes a unit besides themselves; rows with equal ids are cut by equal
draws; other columns stay as they are, and the struct's name evades theirs; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_of

UNIT = r"(?s:.)"
#: Prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are cut, and of 100 cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def cut(seed: str, text: str, unit: regex.Pattern, rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends = array("I", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    n = len(ends) - 1
    digest = hashlib.sha256(f"1:{seed}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = ends[a], ends[b]
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return n, "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text that ``cut`` was given; no mark stands in it, so each first find is the mark itself."""
    if form == "plain":
        return output
    one, two, three = MARKS if form == "psm" else (MARKS[1], MARKS[0], MARKS[2])
    head, _, rest = output.removeprefix(one).partition(two)
    tail, _, middle = rest.partition(three)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def infilled(doc_id: Column, text: Column, unit: str = UNIT, rate: int = CUT, spm: int = SUFFIX_FIRST) -> Column:
    """A struct of ``FIELDS``: the transformed text and how it was cut."""
    if not (0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("rate and spm are percentages")
    pattern = regex.compile(unit)

    @F.pandas_udf(FIELDS)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [cut(i, t, pattern, rate, spm) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from a transformed one and its form."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuild(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)


def digests(output: Column, form: Column) -> Column:
    """output_sha256, restored_sha256 of transformed texts."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return pd.DataFrame([(sha(o), sha(rebuild(o, f))) for o, f in zip(outputs, forms)], columns=["output_sha256", "restored_sha256"])

    return run(output, form)


def transform(docs: DataFrame, unit: str = UNIT, rate: int = CUT, spm: int = SUFFIX_FIRST, name: str = "infill") -> DataFrame:
    """The rows of ``docs`` with a struct of ``FIELDS`` more, named ``name`` or, where that is taken, with underscores after it."""
    return docs.withColumn(free_name(docs, name), infilled(F.col("doc_id"), text_of(), unit, rate, spm))


def query(docs: DataFrame) -> DataFrame:
    d = transform(docs.select("doc_id", "text")).select("doc_id", "infill.*")
    d = d.withColumn("d", digests(F.col("output"), F.col("form")))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.output_sha256", "d.restored_sha256")


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
h as (
  select doc_id, t, cast(length(t) as bigint) as n,
    cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2, cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4
  from d),
c as (
  select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from h)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t
    when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end) as output_sha256,
  sha256(t) as restored_sha256
from c
"""

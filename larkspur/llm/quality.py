"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the numbers that
the rules look at and one bit per failed rule; policies (a version is a mask of
the rules that reject) and ablations are bitwise work on the ledger and never
look at a text again.

Defined cases: a null text counts as empty (no words, so it fails
``few_words``); a long text is measured whole; rows repeat as often as they come;
columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an
empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_SET, durable, settle, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule name -> failure condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbol_heavy": "10 * n_symbols > 4 * word_chars",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 40 * n_words)",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policy version -> mask of the rules whose failure rejects a document.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}


def _repeated(windows: str) -> Column:
    """Words inside windows that occur twice or more, from window hashes.

    Only texts with such a window pay for the sort of the positions.
    """
    # positions grouped by window: equal neighbours after the sort occur again
    order = f"sort_array(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))"
    spots = (
        f"transform(array({order}), s -> sort_array(transform(filter(s, (x, k) -> "
        "coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)), y -> y.i)))[0]"
    )
    covered = (
        f"aggregate({spots}, named_struct('last', -{WINDOW}, 'n', 0L), "
        f"(a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last)), a -> a.n)"
    )
    return F.expr(f"case when size(array_distinct({windows})) < size({windows}) then {covered} else 0L end")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the six measurements of every whole text."""
    d = docs.select("doc_id", text_of().alias("text"))
    # one piece more than there are blanks, and an empty piece beside each further blank
    d = settle(d, "doc_id", "text", F.split("text", f"[{BLANK_SET}]", -1).alias("pieces"))
    d = d.select("doc_id", "text", (F.size("pieces") - 1).alias("n_blank"), F.array_remove("pieces", "").alias("words"))
    d = settle(
        d, "doc_id", "text", "n_blank",
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    parts = ", ".join(f"hashes[i + {k}]" for k in range(WINDOW))
    windows = F.expr(
        f"case when size(hashes) >= {WINDOW} then transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({parts})) "
        "else cast(array() as array<bigint>) end"
    )
    d = settle(d, "doc_id", "text", "n_blank", "n_words", windows.alias("windows"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANK_SET}]"))
    d = settle(d, "doc_id", "text", "n_blank", "n_words", _repeated("windows").alias("n_repeat_words"), lines.alias("lines"))
    return settle(
        d, "doc_id",
        "n_words",
        (F.char_length("text") - F.col("n_blank")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, the bits of the rules that each document fails."""
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measure(docs).withColumn("failed", bits)


def apply_policy(led: DataFrame, version: str) -> DataFrame:
    """Adds ``kept``: none of the policy's rules failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(led: DataFrame, version: str) -> DataFrame:
    """One row per rule of a policy: how many documents fail it, and how many only it rejects.

    A single aggregate over the bits; the texts are not read again.
    """
    mask = POLICIES[version]
    names = [n for n in RULES if BIT[n] & mask]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    one = led.agg(
        *[F.count_if(hit.bitwiseAND(F.lit(BIT[n])) != 0).alias(f"f_{n}") for n in names],
        *[F.count_if(hit == BIT[n]).alias(f"o_{n}") for n in names],
        F.coalesce(F.bit_or("failed"), F.lit(0)).alias("any_bits"),
        F.count("*").alias("n_docs"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names])
    return one.select("n_docs", "any_bits", F.inline(rows))


def sole_rule(version: str) -> Column:
    """The rule that alone rejects a document, from its bits; null if none or several do."""
    hit = F.col("failed").bitwiseAND(F.lit(POLICIES[version]))
    out = F.when(F.lit(False), F.lit(""))
    for name, bit in BIT.items():
        out = out.when(hit == bit, F.lit(name))
    return out


def query(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger is written once; the policy and the ablation of the rule that alone rejects a document are read from its bits."""
    led = apply_policy(durable(ledger(docs)), version).withColumn("sole_rule", sole_rule(version))
    cut = ablations(led, version).select(F.col("rule").alias("sole_rule"), F.col("n_only").alias("n_sole"))  # a row a rule
    return led.join(F.broadcast(cut), "sole_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        "kept", F.col("failed").cast("long").alias("failed"), "sole_rule", F.coalesce("n_sole", F.lit(0)).cast("long").alias("n_sole"),
    )


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
win as (
  select doc_id, p, array_to_string(words[p:p+4], ' ') as g
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as p from w where len(words) >= 5)),
rep as (
  select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (
  select doc_id, count(distinct p + k) as n from rep, (select unnest(range(0, 5)) as k) group by doc_id),
m as (
  select w.doc_id, cast(len(words) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
  from w left join cov on cov.doc_id = w.doc_id),
f as (
  select *, cast(
      (case when n_words < 10 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > 4 * word_chars then 4 else 0 end)
    + (case when n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
    + (case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 40 * n_words) then 16 else 0 end) as bigint) as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       failed = 0 as kept, failed,
       case failed when 1 then 'few_words' when 2 then 'repeated_words' when 4 then 'symbol_heavy' when 8 then 'duplicate_lines' when 16 then 'word_length' end as sole_rule,
       case when failed in (1, 2, 4, 8, 16) then count(*) over (partition by failed) else 0 end as n_sole
from f
"""

"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per document and stores the measurements
with one long of failure bits (bit b: rule b failed). Policies are versioned
sets of rules applied to the stored bits, so a new policy, an older version or
an ablation never reads the texts again: ``apply_policy`` is a bitwise AND, and
``ablations`` folds the ledger into counts per distinct bit pattern (at most
2**rules rows, pre-aggregated map-side) and derives from those what each rule
removes alone.

Words are ``[^\\x20\\x09-\\x0D]+``. A word is repeated when it lies in a 3-word
window found twice or more in the text; windows are compared by the 64-bit
XXHash of their words within one document.

Edge cases: a null text has no words, lines or symbols; it fails the
``few_words`` rule as an empty text does. A document is judged on its own, so
repeated rows and equal ids get equal results and an empty table gives none.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by the contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""
    bit: int
    name: str
    fails: str


RULES = [
    Rule(0, "few_words", f"n_words < {MIN_WORDS}"),
    Rule(1, "repeated_words", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 4 * n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
]


@dataclass(frozen=True)
class Policy:
    """Documents failing any of ``rules`` are dropped."""
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules=None) -> int:
        bits = {r.name: r.bit for r in rules or RULES}
        return sum(1 << bits[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    Policy("web", 1, ("few_words", "repeated_words")),
    Policy("web", 2, ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words")),
)}

_WS = "[\\x20\\x09-\\x0D]+"


def _once(c: Column) -> Column:
    """``c`` (the condition always holds), computed where it stands: the optimiser
    neither copies it into its uses, where an array would be built again for
    every element, nor pushes filters below it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the measurements the rules read."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("_text"))
    d = d.select(
        "doc_id",
        _once(F.array_remove(F.split("_text", _WS), "")).alias("_words"),
        _once(F.filter(F.split("_text", "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))).alias("_lines"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    starts = F.slice(F.col("_words"), F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.struct(
        F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))
    d = d.select(
        "doc_id", "n_symbols", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _once(F.sort_array(windows)).alias("_sorted"))

    def tied(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get("_sorted", k - 1)["h"])
        after = F.get("_sorted", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    d = d.withColumn("_again", _once(F.sort_array(F.transform(F.filter("_sorted", tied), lambda x: x["i"]))))
    # Window i covers words i, i + 1, i + 2: count up to the next window's start.
    steps = F.transform("_again", lambda x, k: F.coalesce(F.least(F.get("_again", k + 1) - x, F.lit(3)), F.lit(3)))
    repeats = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                    _once(repeats).alias("n_repeat_words"))


def failure_bits(rules=None) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules or RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """Measurements and ``failure_bits`` of every rule, one row per document."""
    return measure(docs, id_col, text_col).withColumn("failure_bits", failure_bits(rules))


def apply_policy(led: DataFrame, policy: Policy, rules=None) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablations(led: DataFrame, policy: Policy, rules=None) -> DataFrame:
    """Per rule of the policy: documents it fails, documents only it fails
    (those come back without it) and the policy's drops without it."""
    rules = rules or RULES
    mask = F.lit(policy.mask(rules)).cast("long")
    patterns = (led.select(F.col("failure_bits").bitwiseAND(mask).alias("bits"))
                .groupBy("bits").agg(F.count(F.lit(1)).alias("n")))
    table = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                                for r in rules if r.name in policy.rules]))
    each = patterns.select("bits", "n", table.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    left = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(left != 0, F.col("n")).otherwise(0)).alias("dropped_without"))


def quality_report(docs: DataFrame, version: int = 2) -> DataFrame:
    """The digest columns of the ledger under one policy version."""
    led = apply_policy(ledger(docs), POLICIES[version])
    base = F.col("failure_bits").bitwiseAND(F.lit(BASE.mask()).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), "kept", "n_lines", "failure_bits")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > 4 * n_words AS f2,
         10 * n_dup_lines > 5 * n_lines AS f3, word_chars > 20 * n_words AS f4, word_chars < 2 * n_words AS f5
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept, n_lines,
       CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT AS BIGINT) AS failure_bits
FROM f
"""

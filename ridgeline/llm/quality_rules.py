"""Quality rules as a short-circuit cascade.

The cost and the rejection rate of each rule are estimated on a bounded sample;
rules run in order of rejections per cost, and a rule sees only what its
predecessors let through. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import common

SPAN = 5


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean column over ``text`` and the base columns; null does not reject."""
    name: str
    rejects: Column


def letters(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def default_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        Rule("repeated_lines", 100 * c("n_dup_lines") > 30 * F.size(F.split(c("text"), "\n"))),
        Rule("shouting", 2 * letters(c("text"), r"\p{Lu}") > letters(c("text"), r"\p{L}")),
        Rule("exclamations", 5 * letters(c("text"), "!") > c("n_words")),
        Rule("no_letters", 10 * letters(c("text"), r"\p{L}") < 5 * c("word_chars")),
    ]


def measure(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule over a written sample."""
    out = []
    sample.agg(F.count("*")).first()  # opens the files once before the clock runs
    for rule in rules:
        began = time.perf_counter()
        hit, n = sample.agg(F.count_if(rule.rejects), F.count("*")).first()
        out.append((rule, time.perf_counter() - began, hit / max(n, 1)))
    return out


def order(measured: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per second first; the name settles ties."""
    return [r for r, cost, share in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-6), m[0].name))]


def cascade(rules: Sequence[Rule], before: Column) -> Column:
    """True if nothing rejects. ``before`` is a verdict that is known already. CASE stops at the first branch that holds."""
    out = F.when(before, False)
    for rule in rules:
        out = out.when(rule.rejects, False)
    return out.otherwise(True)


def repeat_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more in the text.

    Windows are 64-bit hashes. Most texts repeat none, which a hash set shows; the
    others sort (hash, position) and add up the union of the repeated windows, n log n for any text.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - SPAN + 1, F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SPAN)]))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        starts = common.let(pairs, lambda s: F.array_sort(F.transform(F.filter(
            s, lambda x, i: same(s, i, i + 1) | (F.when(i > 0, same(s, i, i - 1)).otherwise(False))), lambda x: x["i"])))
        return common.let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(p, i + 1) - x, F.lit(SPAN)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return common.let(hashes, lambda h: common.let(windows(h), lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(common.WORD)))
    d = d.withColumns({
        "_w": common.let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))),
        "word_chars": F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": common.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")})
    d = d.select("doc_id", "text", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def filter_quality(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 500) -> DataFrame:
    """Base columns and ``kept`` of every document, in one pass over the texts.

    The sample, of about ``sample_rows`` rows drawn by a hash of the id, only sets the
    order of the rules. Null text has no words and fails; ids may be null or repeat (each row is judged
    alone); an empty table gives an empty result; other columns are not read.
    """
    rules = default_rules() if rules is None else list(rules)
    n = max(docs.count(), 1)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample_rows).limit(2 * sample_rows)
    ordered = order(measure(common.written(base(drawn), "quality-sample"), rules))
    return base(docs).withColumn("kept", cascade(ordered, F.col("base_failed")))


def op1_quality(docs: DataFrame) -> DataFrame:
    return filter_quality(docs).drop("text")

"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the word sequences of all benchmark items. A
document's words run through it while the length of the longest match ending at each
word is tracked. Where that reaches a window's length, the words of the window are hit, and the
state names the items. Spans that reach the length limit are removed; documents beyond the coverage limit are contaminated.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

#: Fixed pattern of the contract on lower-cased UTF-8: every byte of a character beyond ASCII belongs to a word.
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
SPAN = 13


def tokens(text: str) -> list[bytes]:
    return TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only


class Automaton:
    """Generalised suffix automaton; a state stands for substrings of lengths (length of its link, own length]."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], span: int = SPAN):
        self.span, self.vocabulary = span, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("q", [-1]), array("q", [0])
        names: list[set] = [set()]
        shorts: list[tuple[list[int], str | None]] = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
                names += [set() for _ in range(len(self.next) - len(names))]
                names[last].add(name)
            if 0 < len(ids) < span:
                shorts.append((ids, name))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            names[self.link[s]] |= names[s]
        self.shortest = min([span, *[len(i) for i, _ in shorts]])
        self.window = array("q", [self._window_state(s) for s in range(len(self.next))])
        used = set(self.window)
        self.names = {s: frozenset(names[s]) for s in used if s >= 0}
        self.whole: dict[int, list[tuple[int, str | None]]] = {}
        for ids, name in shorts:
            s = 0
            for c in ids:
                s = self.next[s][c]
            self.whole.setdefault(s, []).append((len(ids), name))

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _window_state(self, s: int) -> int:
        """The state of the suffix of window length of any match at s, or -1."""
        if self.length[s] < self.span:
            return -1
        while self.length[self.link[s]] >= self.span:
            s = self.link[s]
        return s

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit runs [start, end) of words, and the names of the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        runs: list[tuple[int, int]] = []
        names: set = set()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= self.shortest:
                self._scan_run(ids[a:b].tolist(), int(a), runs, names)
        return union(runs), names

    def _scan_run(self, ids: list[int], at: int, runs: list, names: set) -> None:
        s = n = 0
        for i, c in enumerate(ids):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            if n >= self.span and self.window[s] >= 0:
                runs.append((at + i + 1 - self.span, at + i + 1))
                names |= self.names[self.window[s]]
            if self.whole:
                t = s
                while t > 0:
                    for length, name in self.whole.get(t, ()):
                        if length <= n:
                            runs.append((at + i + 1 - length, at + i + 1))
                            names.add(name)
                    t = self.link[t]


def union(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = "n_words long, runs array<struct<a:long,b:long>>, items array<string>"


def scanner(automaton: Automaton | None):
    @F.pandas_udf(HITS)
    def scan(text: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, old_runs, old_items in zip(text, before["runs"], before["items"], strict=True):
            words = tokens(t or "")
            runs, names = automaton.scan(words) if automaton else ([], set())
            runs = union([*((r["a"], r["b"]) for r in old_runs), *runs])
            rows.append((len(words), [{"a": a, "b": b} for a, b in runs], sorted({*old_items, *(n for n in names if n is not None)})))
        return pd.DataFrame(rows, columns=["n_words", "runs", "items"])
    return scan


def parts_of(part_words: int, span: int):
    """Column function: words of a text in parts of ``part_words`` windows; neighbours share ``span`` - 1 words, so every window lies in one part whole."""
    @F.pandas_udf("array<string>")
    def parts(text: pd.Series) -> pd.Series:
        def one(t):
            words = tokens(t)
            if len(words) < part_words + span:
                return [t]
            return [b" ".join(words[k:k + part_words + span - 1]).decode("utf-8", "replace") for k in range(0, len(words) - span + 1, part_words)]
        return pd.Series([one(t) for t in text], dtype=object)
    return parts


def before_last(docs: DataFrame, benchmark: DataFrame, block_words: int, span: int) -> tuple[DataFrame, Automaton]:
    """``docs`` with the ``hits`` of all blocks but the last, and the automaton of the last."""
    common.bound_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    if blocks > 1:  # parts far smaller than a block, so that the hash fills blocks evenly
        parts = items.select("i", F.explode(parts_of(max(span, block_words // 64), span)(F.col("t"))).alias("t")).distinct()
        items = common.written(parts, "decontaminate-items")
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<a:long,b:long>>").alias("runs"), F.array().cast("array<string>").alias("items"))
    out = docs.withColumn("hits", empty)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        automaton = Automaton([(r["i"], tokens(r["t"])) for r in own.orderBy("i", "t").collect()], span)
        if k + 1 < blocks:
            out = common.written(out.withColumn("hits", scanner(automaton)(F.col("text"), F.col("hits"))), "decontaminate-block")
    return out, automaton


def find_hits(docs: DataFrame, benchmark: DataFrame, block_words: int = 500_000, span: int = SPAN) -> DataFrame:
    """``docs`` plus ``hits`` (n_words, runs of hit words, item ids as strings).

    Repeated items (same id and text) count once. The words of the rest are counted first. Up to ``block_words`` of them make
    one automaton, which every task gets; beyond, long items are cut into overlapping parts, the parts are dealt to blocks
    by a hash and the documents pass block after block, so memory stays bounded and the result is the same.

    Null or empty texts have no words and no hits; repeated rows get the same hits; without items, or without documents, nothing is
    hit; items with a null id hit but are not listed. A column ``hits`` is replaced, others pass through.
    """
    out, automaton = before_last(docs, benchmark, block_words, span)
    return out.withColumn("hits", scanner(automaton)(F.col("text"), F.col("hits")))


def judged(docs: DataFrame, benchmark: DataFrame, coverage: int = 20) -> DataFrame:
    """doc columns, hits, n_hit and ``contaminated`` (at least one word of every ``coverage`` is hit)."""
    out = find_hits(docs, benchmark)
    out = out.withColumn("n_hit", F.aggregate("hits.runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("hits.n_words")))


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """Text without the hit words and what stands between the words of one run."""
    raw = text.encode("utf-8", "surrogatepass")
    at, keep, last = [m.span() for m in TOKEN.finditer(raw.lower())], [], 0
    for a, b in runs:
        keep.append(raw[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")


def cleaner(automaton: Automaton, coverage: int):
    """Last scan, verdict and cut of a text in one pass; ``clean`` is null for texts that are contaminated or not hit.

    Marked as not deterministic, so that a filter on the verdict does not scan again in a Python worker of its own.
    """
    @F.pandas_udf("contaminated boolean, clean string")
    def clean(text: pd.Series, before: pd.Series) -> pd.DataFrame:
        rows = []
        for t, old in zip(text, before, strict=True):
            words = tokens(t or "")
            runs = union([*((r["a"], r["b"]) for r in old), *automaton.scan(words)[0]])
            hit = sum(b - a for a, b in runs)
            bad = hit > 0 and coverage * hit >= len(words)
            rows.append((bad, cut(t, runs) if hit and not bad else None))
        return pd.DataFrame(rows, columns=["contaminated", "clean"])
    return clean.asNondeterministic()


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: int = 20, block_words: int = 500_000) -> DataFrame:
    """Documents that are not contaminated, without the spans that reach the length limit; ``n_chars``, if there, follows the text.

    Null or empty texts have no words and stay; repeated rows are judged alike; an empty benchmark removes
    nothing, and an item without words is ignored. Items with a null id hit but are not listed. Other columns pass through whatever their names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    scanned, automaton = before_last(packed, benchmark, block_words, SPAN)
    kept = scanned.select("doc", cleaner(automaton, coverage)(F.col("text"), F.col("hits.runs")).alias("r")).where(~F.col("r.contaminated"))
    clean = F.col("r.clean")  # null: as it was
    new = {"text": F.coalesce(clean, F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(clean.isNotNull(), F.length(clean).cast("long")).otherwise(F.col("doc.n_chars"))
    return kept.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", F.col("hits.n_words").alias("n_words"), "n_hit", F.size("hits.items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), "contaminated")

"""Secret scan: fixed patterns plus sliding-window entropy over candidate strings.

Each character class has its own candidate pattern, window and threshold. Counts of the
window's characters are updated as it moves, so a candidate costs its length.
Allow-listed candidates (words, plain numbers, identifiers) are suppressed; a placeholder word suppresses
only the find, or the part of it between separators, that holds the word.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

# Fixed patterns of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the length can stand in the pattern
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidates are maximal runs of ``chars``; a window of ``window`` characters with ``bits`` or more is a find."""
    name: str
    chars: str
    window: int
    bits: float

    def pattern(self) -> re.Pattern:
        return re.compile(rf"(?<![{self.chars}])[{self.chars}]{{{self.window},}}")


CLASSES = (CharClass("hex", "0-9a-fA-F", 24, 3.0), CharClass("base64", "A-Za-z0-9+/_=-", 24, 3.9))
ALLOW = (
    r"[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]*",                                   # words, also joined
    r"[0-9]+([-_/=+][0-9]+)*",                                                 # numbers, dates
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"[-_/=+]*",
)
PLACEHOLDER = r"(?i:example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh)"
TOKENS, PARTS = re.compile(r"[^-_/=+]+"), "-_/=+"
#: A longer token holds a placeholder word by chance or by the way, so only the word itself goes.
LONGEST = 64


def hot_spans(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``s`` whose Shannon entropy reaches ``bits``."""
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    count: dict[str, int] = {}
    total, out, limit = 0.0, [], (math.log2(window) - bits) * window + 1e-9
    for i, ch in enumerate(s):
        if i >= window:
            c = count[s[i - window]]
            total += term[c - 1] - term[c]
            count[s[i - window]] = c - 1
        c = count.get(ch, 0)
        total += term[c + 1] - term[c]
        count[ch] = c + 1
        if i >= window - 1 and total <= limit:
            a = i - window + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def remaining(run: str, words: re.Pattern) -> list[tuple[int, int]]:
    """The run, or what is left of it without the tokens (in long ones, the characters) of placeholder words."""
    if not words.search(run):
        return [(0, len(run))]
    cuts = []
    for t in TOKENS.finditer(run):
        held = [(t.start() + w.start(), t.start() + w.end()) for w in words.finditer(t[0])]
        cuts += held if len(t[0]) > LONGEST else [t.span()] * bool(held)
    out = []
    for a, b in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(run)], strict=True):
        s = run[a:b].rstrip(PARTS)
        out.append((a + len(s) - len(s.lstrip(PARTS)), a + len(s)))
    return out


def entropy_spans(text: str, classes, patterns, allow: re.Pattern, words: re.Pattern) -> list[tuple[int, int]]:
    found = []
    for k, p in zip(classes, patterns, strict=True):
        for m in p.finditer(text):
            if allow.fullmatch(m[0]):
                continue
            for x, y in remaining(m[0], words):
                if y - x >= k.window and not allow.fullmatch(m[0], x, y):
                    found += [(m.start() + x + a, m.start() + x + b) for a, b in hot_spans(m[0][x:y], k.window, k.bits)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def uncovered(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` (sorted by start) that no base span holds whole: one merge, with the greatest end of the base spans begun so far."""
    starts, at, reach, out = sorted((x, y) for _, x, y in base), 0, -1, []
    for a, b in spans:
        while at < len(starts) and starts[at][0] <= a:
            reach, at = max(reach, starts[at][1]), at + 1
        if reach < b:
            out.append((a, b))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_documents(docs: DataFrame, classes=CLASSES, allow=ALLOW, placeholder=PLACEHOLDER) -> DataFrame:
    """All columns of ``docs`` plus n_assign, n_access, n_hex, base_sha256 and spans (replaced if there).

    Spans are code points, end exclusive. Base matches always stay; an entropy span is added unless a base
    span holds all of it. Null text is empty and has no span; rows are judged alone, in time near linear in the
    length of a text. An empty table stays empty; columns named like the new ones are replaced.
    """
    common.bound_batches(docs.sparkSession)
    patterns, allowed = [k.pattern() for k in classes], re.compile("|".join(f"(?:{a})" for a in allow))
    words = re.compile(placeholder)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            t = t or ""
            base = base_spans(t)
            more = [("entropy", a, b) for a, b in uncovered(entropy_spans(t, classes, patterns, allowed, words), base)]
            kinds = [k for k, _, _ in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                         hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    new = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    cols = [c for c in docs.columns if c not in new]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), scan(F.col("text")).alias("s"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in cols], *[F.col(f"s.{c}").alias(c) for c in new])


def op5_secrets(docs: DataFrame) -> DataFrame:
    return scan_documents(docs.select("doc_id", "text")).drop("text")

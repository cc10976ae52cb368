"""Language identification with error-correcting output codes.

Every language has a codeword; one linear classifier a bit, over hashed byte
n-grams, predicts that bit. Decoding sums the hinge losses of all bits, each weighted by
its classifier's leave-one-out accuracy, and takes the nearest codeword; a
second codeword almost as near flags the text as ambiguous.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

BINS = 4096
CHUNK = 1 << 20
BLOCK = 128  # rows of the training matrices that are worked on at once
LETTER = re.compile(r"[^\W\d_]")


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 3-grams of the whole text; chunks overlap by two bytes."""
    raw, counts = text.lower().encode("utf-8", "replace"), np.zeros(BINS)
    for at in range(0, len(raw), CHUNK):
        own = min(CHUNK, len(raw) - at)
        b = np.frombuffer(raw[at:at + own + 2], dtype=np.uint8).astype(np.uint32)
        for k in (1, 2, 3):
            n = min(own, len(b) - k + 1)
            if n > 0:
                gram = b[:n] + np.uint32(k << 24)
                for j in range(1, k):
                    gram = gram + (b[j:j + n] << np.uint32(8 * j))
                counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    return np.sqrt(counts / max(counts.sum(), 1.0)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1: all splits for few languages, else random splits whose nearest pair is farthest in 50 draws."""
    if n <= 5:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits or [(1,)], dtype=float).T
    draw, bits, best = random.Random(seed), math.ceil(10 * math.log2(n)), None
    for _ in range(50):
        code = np.array([[draw.choice((1, -1)) for _ in range(bits)] for _ in range(n)], dtype=float)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if best is None or near > best[0]:
            best = (near, code)
    return best[1]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    codes: np.ndarray    # languages x bits
    weights: np.ndarray  # features x bits
    trust: np.ndarray    # bits

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword and score 0.5 to 1 (1 for a single language) of rows of margins."""
        loss = (np.maximum(0, 1 - margins[:, None, :] * self.codes[None]) * self.trust).sum(axis=2)
        if len(self.langs) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        two = np.sort(loss, axis=1)[:, :2]
        return loss.argmin(axis=1), two[:, 1] / np.maximum(two.sum(axis=1), 1e-12)


def blocks(n: int) -> list[slice]:
    return [slice(at, min(n, at + BLOCK)) for at in range(0, n, BLOCK)]


def products(x: np.ndarray) -> np.ndarray:
    """x x' in double precision from single-precision rows, of which only two blocks are widened at a time."""
    out = np.empty((len(x), len(x)))
    for i in blocks(len(x)):
        wide = x[i].astype(float)
        for j in blocks(i.stop):
            out[i, j] = wide @ x[j].astype(float).T
            out[j, i] = out[i, j].T
    return out


def invert(a: np.ndarray) -> np.ndarray:
    """Turn a positive definite matrix into its inverse in place, block by block, so that the driver holds it once."""
    for b in blocks(len(a)):
        pivot = np.linalg.inv(a[b, b])
        row, column = pivot @ a[b], a[:, b].copy()
        for i in blocks(len(a)):
            if i != b:
                a[i] -= column[i] @ row
        a[:, b] = -column @ pivot
        a[b] = row
        a[b, b] = pivot
    return a


def train(x: np.ndarray, y: list[str], ridge: float = 1e-2) -> Model:
    """Regularised least squares for all bits in one solve; leave-one-out margins come from the same matrix.

    Beside the rows, single precision will do, the driver holds one matrix of rows x rows.
    """
    langs = sorted(set(y))
    codes = codewords(len(langs))
    want = codes[[langs.index(v) for v in y]]
    inverse = products(x)
    inverse[np.diag_indices(len(x))] += ridge
    invert(inverse)
    dual = inverse @ want
    held = want - dual / np.diag(inverse)[:, None]
    trust = np.maximum(2 * (held * want > 0).mean(axis=0) - 1, 0.05)
    weights = sum((x[i].astype(float).T @ dual[i] for i in blocks(len(x))), np.zeros((x.shape[1], codes.shape[1])))
    return Model(langs, codes, weights, trust)


def pack(p: np.ndarray) -> bytes:
    """The bins of a profile that are not zero, each with its value: a text has far fewer than there are bins."""
    at = np.flatnonzero(p)
    return at.astype("<u2").tobytes() + p[at].astype("<f4").tobytes()


def unpack(raw: bytes, into: np.ndarray) -> None:
    n = len(raw) // 6
    into[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)


def training_rows(docs: DataFrame) -> Column:
    """True for rows that may teach: crc32 of the id as text is not 2 modulo 4."""
    return ~held_out(docs)


def held_out(docs: DataFrame) -> Column:
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 400, most_rows: int = 4000) -> Model | None:
    """Learn from at most ``per_lang`` labelled rows a language, ``most_rows`` in all, drawn by a hash of the row."""
    rows = docs.where(training_rows(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_rows // 2).collect()
    if not counts:
        return None
    each = max(2, min(per_lang, most_rows // len(counts)))
    share = F.create_map(*itertools.chain(*[(F.lit(r["lang"]), F.lit(min(1.0, 2 * each / r["count"]))) for r in counts]))
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= each)

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: pack(profile(t)))

    got = drawn.select("lang", "k", packed("text").alias("x")).collect()
    got.sort(key=lambda r: (r["lang"], r["k"]))
    x = np.zeros((len(got), BINS), np.float32)
    for r, row in zip(got, x, strict=True):
        unpack(bytes(r["x"]), row)
    return train(x, [r["lang"] for r in got])


def predictor(model: Model | None, near: float):
    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score, doubt = ["und"] * len(text), np.zeros(len(text)), [True] * len(text)
        known = [i for i, t in enumerate(text) if model is not None and t is not None and LETTER.search(t)]
        for lo in range(0, len(known), 256):
            some = known[lo:lo + 256]
            best, sure = model.decode(np.stack([profile(text[i]) for i in some]) @ model.weights)
            for i, b, s in zip(some, best, sure, strict=True):
                lang[i], score[i], doubt[i] = model.langs[b], s, bool(s < near)
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": doubt})
    return predict


def identify(docs: DataFrame, near: float = 0.55, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Needs doc_id, text and lang (any may be null); columns with the result's names are replaced.
    Texts that are null or have no letter are ``und`` with score 0 and ambiguous. Without any
    labelled row everything is ``und``. Rows are judged alone, so repeated rows agree.
    """
    common.bound_batches(docs.sparkSession)
    model = model or fit(docs)
    cols = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    p = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), predictor(model, near)(F.col("text")).alias("p"))
    return p.select(*[F.col("row").getField(c).alias(c) for c in cols],
                    F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is clear, with their own columns; ``und`` and ambiguous ones go."""
    out = identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "lang"))
    return out.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("doc.*")


def op10_language(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", "lang")
    out = identify(d)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score", "ambiguous")

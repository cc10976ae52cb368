"""Removal of long byte strings that occur more than once, by prefix-free parsing.

Rolling-hash triggers cut every text: a trigger is the position whose hash of 64
bytes is the least, leftmost among equals, of some string of ``length`` bytes.
Equal strings have their trigger at the same place, so the strings that share a
trigger form a phrase, and the parse of a document is its sequence of phrases.

- Dictionary: distinct phrases with their counts. A trigger seen once rules its strings out;
  a whole phrase seen twice settles all its strings. That leaves the phrases
  that meet others with the same trigger but other surroundings.
- Suffixes of those dictionary phrases: a corpus suffix is a dictionary
  suffix followed by parse, and only its first ``length`` bytes count. Suffixes are brought
  together first in blocks of neighbours, by the bytes that all of a block have in common, then one by
  one, by (block, hash of these bytes): their class in corpus order. A class with two members or more repeats.

Classes stand in for ranks (128 bits: hash of the trigger's surroundings and hash of the string): no suffix is compared beyond ``length`` bytes and no
order between classes is used, so nothing is sorted globally. Exact copies of a text are parsed but handled once.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import common

C = F.col
GRAM = 64
CHUNK = 1 << 20  # starts a slice of a long text; a phrase is cut there, which the suffix step makes good
BASE = 0x9E3779B97F4A7C15 | 1
PRIMES = (2**31 - 1, 2**31 - 19)
_tables: dict[int, tuple] = {}


def tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each prime: value of each byte, powers of a base and of its inverse."""
    if not _tables:
        draw, n = np.random.default_rng(5), CHUNK + 4096
        for p in PRIMES:
            base = int(draw.integers(2, p - 1))
            rows = [draw.integers(1, p, 256).astype(np.uint64)]
            for b in (base, pow(base, -1, p)):
                power = np.array([pow(b, k, p) for k in range(4096)], dtype=np.uint64)
                leap = np.array([pow(b, 4096 * k, p) for k in range(-(-n // 4096))], dtype=np.uint64)
                rows.append((leap[:, None] * power % np.uint64(p)).ravel()[:n])
            _tables[p] = tuple(rows)
    return list(_tables.values())


class Slice:
    """Prefix sums of a slice of bytes; the hash of any substring is two look-ups for each prime.

    Polynomials modulo two primes of 31 bits at fixed random bases: two different strings of n bytes agree with
    probability below (n / 2^31)^2, whatever their pattern (powers of two as moduli have patterns that always agree).
    """

    def __init__(self, raw: np.ndarray):
        self.parts = []
        for p, (value, power, inverse) in zip(PRIMES, tables(), strict=True):
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(value[raw] * power[:len(raw)] % np.uint64(p), out=sums[1:])
            self.parts.append((np.uint64(p), sums, inverse))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = np.zeros(len(start), dtype=np.uint64)
        for p, sums, inverse in self.parts:
            h = (h << np.uint64(31)) | ((sums[end] - sums[start]) % p * inverse[start] % p)
        h ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xC2B2AE3D27D4EB4F)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: running minima of blocks from both sides."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def slices(raw: np.ndarray, length: int):
    for at in range(0, len(raw) - length + 1, CHUNK):
        yield at, raw[at:at + CHUNK + length - 1]


def phrases(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Trigger hash, phrase hash, first start, number of starts, and bytes from first start to trigger of all phrases of a text."""
    parts = []
    for at, part in slices(raw, length):
        s = Slice(part)
        grams = np.arange(len(part) - GRAM + 1)
        h = s.hashes(grams, grams + GRAM)
        place = np.uint64((1 << 21) - 1)
        trigger = (sliding_least((h & ~place) | grams.astype(np.uint64), length - GRAM + 1) & place).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(trigger)) + 1))
        count = np.diff(np.concatenate((first, [len(trigger)])))
        parts.append((h[trigger[first]], s.hashes(first, first + count - 1 + length), first + at, count, trigger[first] - first))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


PHRASE = "array<struct<core:long,cover:long,at:long,n:long,off:long>>"


def structs(**columns) -> list[dict]:
    return [dict(zip(columns, row, strict=True)) for row in zip(*[np.asarray(v).astype(np.int64).tolist() for v in columns.values()], strict=True)]


def parser(length: int):
    @F.pandas_udf(PHRASE)
    def parse(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            raw = np.frombuffer(as_bytes(t), dtype=np.uint8)
            out.append(structs(**dict(zip(("core", "cover", "at", "n", "off"), phrases(raw, length), strict=True))) if len(raw) >= length else [])
        return pd.Series(out)
    return parse


def mix(a, b) -> np.ndarray:
    h = (np.asarray(a).astype(np.uint64) * np.uint64(BASE)) ^ np.asarray(b).astype(np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def blocks(raw: np.ndarray, g: dict, size: int, length: int) -> dict[str, np.ndarray]:
    """Blocks of ``size`` neighbouring starts of a phrase, counted from its trigger, so that equal suffixes fall into equal blocks.

    ``core``: old core, block number and the bytes common to all suffixes of a full block; ``cover``: all bytes of the block.
    """
    s = Slice(raw)  # of the phrase alone; positions below are relative to its start
    far, near = g["off"], g["off"] - g["n"] + 1  # distances of the first and the last start from the trigger
    number = np.arange(far // size, near // size - 1, -1)
    first, last = far - np.minimum(number * size + size - 1, far), far - np.maximum(number * size, near)
    inner = far - number * size  # of a block whose nearest starts belong to the next phrase, still within each of its suffixes
    common_ = s.hashes(np.minimum(inner, len(raw)), np.minimum(inner - size + 1 + length, len(raw)))
    return {"core": mix(mix(np.full(len(number), g["core"]), number), common_), "cover": s.hashes(first, last + length),
            "at": g["at"] + first, "n": last - first + 1, "off": far - first}


def splitter(size: int, length: int):
    """Blocks of the open phrases, with their weights."""
    @F.pandas_udf("array<struct<core:long,cover:long,at:long,n:long,off:long,w:long>>")
    def split(text: pd.Series, open_: pd.Series) -> pd.Series:
        out = []
        for t, phrases_ in zip(text, open_, strict=True):
            raw, rows = np.frombuffer(as_bytes(t), dtype=np.uint8), []
            for g in phrases_:
                x = blocks(raw[g["at"]:g["at"] + g["n"] - 1 + length], g, size, length)
                rows += structs(**x, w=np.full(len(x["n"]), g["w"]))
            out.append(rows)
        return pd.Series(out)
    return split


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remover(length: int):
    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, kept binary")
    def remove(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, rs in zip(text, runs, strict=True):
            raw = as_bytes(t)
            spans = merged((r["at"], r["at"] + r["n"] - 1 + length) for r in rs)
            kept, last = [], 0
            for a, b in spans:
                kept.append(raw[last:a])
                last = b
            rest = b"".join([*kept, raw[last:]])
            rows.append((len(raw) - len(rest), len(spans), sha256(rest).hexdigest(), rest))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept"])
    return remove


OPEN = "struct<core:long,at:long,n:long,off:long,w:long>"
BLOCK = 16


def settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (core, cover, t, at, n, off, w) -> rows whose cover is there twice, and open ones.

    Open: one copy of every cover that meets another cover of its core, of weight 2 if it is there twice; a core with one cover needs no
    closer look. Counts are partial sums and small sides, so a hot core or cover meets in no single task.
    """
    phrase = rows.groupBy("core", "cover").agg(F.sum("w").alias("k"), F.min(F.struct("t", "at", "n", "off")).alias("x"))
    phrase = common.written(phrase, f"suffix-{name}")
    mixed = phrase.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
    done = rows.where("w = 1").join(phrase.where("k > 1").select("core", "cover"), ["core", "cover"]).select("t", "at", "n").distinct()
    return done, phrase.join(mixed, "core").select("core", "x.*", F.least("k", F.lit(2)).cast("long").alias("w"))


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text), with ``with_text`` also ``kept`` (bytes).

    Every byte within a string of ``length`` bytes that also starts elsewhere, in the same row or another, is
    removed; rows are judged on the input. Null text is empty; texts shorter than ``length`` stay whole. Repeated rows are each other's copies. Other columns are not read.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    common.bound_batches(docs.sparkSession)
    text = F.coalesce(C("text"), F.lit(""))
    src = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("t"))
    own = common.written(src.select("doc_id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-documents")
    parse = common.written(src.select("t", F.explode(parser(length)("text")).alias("p")).select("t", "p.*"), "suffix-parse")
    done, open_ = settle(parse.withColumn("w", F.lit(1).cast("long")), "phrases")
    lists = done.select("t", F.struct("at", "n").alias("done"), F.lit(None).cast(OPEN).alias("open")).unionByName(
        open_.select("t", F.lit(None).cast("struct<at:long,n:long>").alias("done"), F.struct("core", "at", "n", "off", "w").alias("open")))
    lists = lists.groupBy("t").agg(F.collect_list("done").alias("done"), F.collect_list("open").alias("open"))
    texts = src.groupBy("t").agg(F.first("text").alias("text"))
    live = common.written(texts.join(lists, "t"), "suffix-texts")
    some = live.where(F.size("open") > 0)
    part = common.written(some.select("t", F.explode(splitter(BLOCK, length)("text", "open")).alias("s")).select("t", "s.*"), "suffix-blocks")
    done2, open2 = settle(part, "blocks")
    open2 = open2.groupBy("t").agg(F.collect_list(F.struct("core", "at", "n", "off", "w")).alias("open"))
    tails = live.select("t", "text").join(open2, "t").select("t", F.explode(splitter(1, length)("text", "open")).alias("s")).select("t", "s.*")
    done3, _ = settle(common.written(tails, "suffix-tails"), "tails")
    found = done2.union(done3).groupBy("t").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    runs = F.concat("done", F.coalesce("found", F.array().cast("array<struct<at:long,n:long>>")))
    cut = live.select("t", "text", "done").join(found, "t", "left").select("t", remover(length)("text", runs).alias("r"))
    cut = cut.select("t", "r.*") if with_text else cut.select("t", "r.n_removed", "r.n_spans", "r.kept_sha256")
    out = own.join(common.written(cut, "suffix-removed"), "t", "left")
    none = F.lit(0).cast("long")
    result = out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
                        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "t", *(["kept"] if with_text else []))
    if not with_text:
        return result.drop("t")
    whole = texts.select("t", F.encode("text", "UTF-8").alias("_whole"))
    return result.join(whole, "t").withColumn("kept", F.coalesce("kept", "_whole")).drop("t", "_whole")


def op2_suffix(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"))

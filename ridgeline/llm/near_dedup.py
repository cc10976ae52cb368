"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact verification.

Nodes are distinct shingle sets, so exact copies never meet one another. Banded
signatures give candidates in two rounds. First every bucket links its members to a few hubs, the
member that shares most buckets and some drawn by a hash; that joins large groups with a few
pairs a member. Then only pairs whose ends are still in different components are looked at,
and a first batch, one bit of each of 4,096 further minima, is compared within the join.
Candidates are compared signature batch by batch and dropped once the posterior
probability of the wanted similarity falls below the chosen miss probability;
survivors are verified on their full sets of words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from . import common

C = F.col


@dataclass(frozen=True)
class Settings:
    """Shingle length in words, similarity as a fraction, bands of rows, and miss probability of the pruning.

    36 bands of 5 rows miss a pair of similarity 0.8 with probability (1 - 0.8^5)^36 = 6e-7.
    Sets up to ``exact`` shingles travel whole with their sketch.
    Members of buckets with over ``small`` pairs a member between components are paired by their rarest shingles instead,
    which misses no similar pair. No task compares with more than about ``tile`` sets of a bucket at once.
    """
    words: int = 5
    similarity: tuple[int, int] = (80, 100)
    bands: int = 36
    rows: int = 5
    miss: float = 1e-6
    batch: int = 36
    small: int = 512
    tile: int = 4096
    bits: int = 4096
    hubs: int = 3
    exact: int = 256


CONTRACT = Settings(words=2)


def tokens(text: str) -> list[bytes]:
    """Words between blanks, tabs and line breaks, A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, k: int) -> set:
    w = tokens(text)
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()


class WordHash(dict):
    """64-bit hashes of the words seen so far; forgets all when full."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def hashed_shingles(text: str, k: int, known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text."""
    w = tokens(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
    n = min(k, len(w))
    out = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i:len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return (draw.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32),
            draw.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1))


def signature(u: np.ndarray, flip: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Upper halves of the minima; slices keep the work within the cache for any set size."""
    h, best = (u >> np.uint64(32)).astype(np.uint32), np.full(len(flip), 2**32 - 1, dtype=np.uint32)
    step = max(64, (1 << 18) // len(flip))
    for at in range(0, len(h), step):
        x = (h[None, at:at + step] ^ flip[:, None]) * factor[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(best, x.min(axis=1), out=best)
    return (best >> np.uint32(16)).astype("<u2")


def sketcher(s: Settings):
    @F.pandas_udf("n long, c binary, sig binary")
    def sketch(text: pd.Series) -> pd.DataFrame:
        flip, factor = permutations(s.bands * s.rows)
        known, rows = WordHash(), []
        for t in text:
            u = hashed_shingles(t or "", s.words, known)
            if len(u):
                rows.append((len(u), blake2b(u.tobytes(), digest_size=16).digest(), signature(u, flip, factor).tobytes()))
            else:
                rows.append((0, None, None))
        return pd.DataFrame(rows, columns=["n", "c", "sig"])
    return sketch


def band_keys(s: Settings):
    @F.pandas_udf("array<long>")
    def keys(sig: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(sig), dtype="<u2").reshape(len(sig), s.bands, s.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), x.shape[:2]).copy()
        for r in range(s.rows):
            h = (h ^ x[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return pd.Series(list(h.astype(np.int64)))
    return keys


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(rows compared, matches below which the posterior of the similarity, from a flat prior, is under ``miss``)."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    wanted = grid >= s.similarity[0] / s.similarity[1]
    out, total = [], s.bands * s.rows
    for n in [*range(s.batch, total, s.batch), total]:
        for m in range(n + 1):
            like = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(like - like.max())
            if p[wanted].sum() >= s.miss * p.sum():
                out.append((n, m))
                break
    return out


def pruner(s: Settings):
    stops = least_matches(s)

    @F.pandas_udf(T.BooleanType())
    def survives(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), dtype="<u2").reshape(len(v), -1) for v in (a, b))
        live, matches, done = np.arange(len(a)), np.zeros(len(a), int), 0
        for upto, least in stops:
            matches[live] += (x[live, done:upto] == y[live, done:upto]).sum(axis=1)
            live, done = live[matches[live] >= least], upto
        out = np.zeros(len(a), bool)
        out[live] = True
        return pd.Series(out)
    return survives


def verifier(s: Settings):
    num, den = s.similarity

    @F.pandas_udf(T.BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(a, b, strict=True):
            x, y = shingle_set(t, s.words), shingle_set(v, s.words)
            both = len(x & y)
            out.append(bool(both) and den * both >= num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)
    return linked


def verify(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Linked pairs (a, b) among candidate pairs. ``nodes``: c, n, sig, text of all candidates."""
    num, den = s.similarity
    thin = nodes.select("c", "n", "sig")
    side = lambda t, x: t.select(*[C(k).alias(x if k == "c" else f"{k}_{x}") for k in t.columns])
    p = pairs.join(side(thin, "a"), "a").join(side(thin, "b"), "b")
    p = p.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    p = common.written(p.where(pruner(s)("sig_a", "sig_b")).select("a", "b"), "near-survivors")
    full = nodes.select("c", "text")
    q = p.join(side(full, "a"), "a").join(side(full, "b"), "b")
    return common.written(q.where(verifier(s)("text_a", "text_b")).select("a", "b"), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for all ends of edges (a, b): least label of the neighbourhood, then pointer jumping, until nothing moves."""
    both = edges.select(C("a").alias("v"), C("b").alias("w")).union(edges.select(C("b").alias("v"), C("a").alias("w")))
    both = common.written(both.distinct(), "near-graph")
    label = common.written(both.groupBy("v").agg(F.least(F.min("w"), C("v")).alias("comp")), "near-labels")
    while True:
        near = both.join(label.select(C("v").alias("w"), C("comp").alias("cw")), "w").groupBy("v").agg(F.min("cw").alias("cw"))
        low = label.join(near, "v").select("v", C("comp").alias("old"), F.least("comp", "cw").alias("mid"))
        jump = label.select(C("v").alias("mid"), C("comp").alias("top"))
        new = common.written(low.join(jump, "mid", "left").select("v", "old", F.least("mid", F.coalesce("top", "mid")).alias("comp")), "near-labels")
        label = new.select("v", "comp")
        if not new.where(C("old") != C("comp")).limit(1).count():
            return label


def with_component(table: DataFrame, label: DataFrame, node: str) -> DataFrame:
    return table.join(label.select(C("v").alias(node), C("comp").alias("_comp")), node, "left").withColumn("comp", F.coalesce("_comp", C(node))).drop("_comp")


def hub_pairs(members: DataFrame, hubs: int) -> DataFrame:
    """Pairs of each member of a bucket with its hubs: the member that shares most buckets of most members, and others drawn by a hash.

    The hash is the member's own, so the buckets of one group draw the same few hubs and give each pair again, not new ones.
    """
    score = members.groupBy("c").agg(F.sum("size").alias("score"))
    drawn = [F.max(F.struct(F.xxhash64("c", F.lit(i)).alias("score"), "c"))["c"] for i in range(1, hubs)]
    hub = members.join(score, "c").groupBy("band").agg(F.array_distinct(F.array(F.max(F.struct("score", "c"))["c"], *drawn)).alias("h"))
    each = members.join(hub, "band").select("c", F.explode("h").alias("h")).where(C("c") != C("h"))
    return each.select(F.least("c", "h").alias("a"), F.greatest("c", "h").alias("b")).distinct()


def most_differences(s: Settings) -> int:
    """Bits of two sketches differ with probability (1 - similarity) / 2; beyond this count the pair is missed with less than ``miss``."""
    n, p = s.bits, (1 - s.similarity[0] / s.similarity[1]) / 2
    tail, k = 1.0, -1
    while tail > s.miss:
        k += 1
        tail -= math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    return k


def bit_sketch(s: Settings):
    """One bit of each of ``bits`` minima, in longs: a batch of rows small enough to travel with a bucket; of sets up to ``exact`` also the whole set."""
    @F.pandas_udf("bits array<long>, own array<long>")
    def sketch(text: pd.Series) -> pd.DataFrame:
        flip, factor = permutations(s.bits, 12)
        known, rows = WordHash(), []
        for t in text:
            u = hashed_shingles(t, s.words, known)
            bits = (signature(u, flip, factor) & 1).astype(np.uint8)
            rows.append((np.packbits(bits).view("<i8").astype(np.int64), u.astype(np.int64) if len(u) <= s.exact else None))
        return pd.DataFrame(rows, columns=["bits", "own"])
    return sketch


def shingle_hashes(s: Settings):
    @F.pandas_udf("array<long>")
    def hashes(text: pd.Series) -> pd.Series:
        known = WordHash()
        return pd.Series([hashed_shingles(t, s.words, known).astype(np.int64) for t in text])
    return hashes


def prefix_blocks(sets: DataFrame, s: Settings) -> DataFrame:
    """(c, band) of ``sets`` (c, n, text): any two that are similar enough have a band in common.

    Shingles are ordered from rare to frequent. Two sets of the wanted similarity share at least ceil(similarity n)
    shingles, so the first one they share is among the first n - ceil(similarity n) + 1 of either. Shingles of one set
    only come first and lead nowhere.
    """
    num, den = s.similarity
    each = common.written(sets.select("c", "n", F.explode(shingle_hashes(s)("text")).alias("band")), "near-shingles")
    often = each.groupBy("band").agg(F.count("*").alias("df")).where("df > 1")
    own = W.partitionBy("c")  # the shingles of one text
    ranked = each.join(often, "band").withColumns({"at": F.row_number().over(own.orderBy("df", "band")), "shared": F.count("*").over(own)})
    return ranked.where(C("at") <= C("shared") - F.floor((C("n") * num + den - 1) / den) + 1).select("c", "band")


def by_tiles(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows`` (band, c, comp) with ``lead``, ``at`` and ``home``, for a join on band and ``at``.

    Each row has one tile of its band as its home. Rows outside the largest component of the band (not ``lead``) also
    go to the other tiles, so those on the left and the homes on the right meet once and
    comparisons are at most twice the pairs of different components.
    """
    parts = rows.groupBy("band", "comp").agg(F.count("*").alias("k")).groupBy("band").agg(
        F.sum("k").alias("k"), F.max(F.struct("k", "comp"))["comp"].alias("most"), F.count("*").alias("parts"))
    tiles = F.ceil(C("k") / s.tile).cast("long")
    r = rows.join(parts.where("parts > 1"), "band").withColumns({"lead": C("comp") == C("most"), "own": F.pmod(F.xxhash64("c"), tiles), "last": tiles - 1})
    r = r.withColumn("at", F.explode(F.when(C("lead"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), "last"))))
    return r.withColumn("home", C("at") == C("own")).select(*rows.columns, "lead", "at", "home")


def cross_pairs(members: DataFrame, label: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs of a bucket whose ends are in different components and may be similar by size and by their bit sketches.

    Members of buckets with more than ``small`` such pairs a member meet by their rarest shingles instead. Elsewhere a
    pair is given by the first of the buckets it shares. Only members of mixed buckets are sketched. Pairs of
    small sets that pass are compared whole right there, since near copies just below the similarity pass every sketch.
    """
    num, den = s.similarity
    m = with_component(members.select("band", "c"), label, "c")
    parts = m.groupBy("band", "comp").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("k"), F.sum(C("k") * C("k")).alias("q"), F.count("*").alias("parts"))
    mixed = parts.where("parts > 1").select("band", (C("k") * C("k") - C("q") > 2 * s.small * C("k")).alias("large"))
    m = common.written(m.join(mixed, "band"), "near-mixed")
    crowd = m.where("large").select("c", "comp").distinct()
    split = prefix_blocks(nodes.join(crowd.select("c"), "c"), s).join(crowd, "c").select("band", "c", "comp", F.lit(True).alias("large"))
    rows = by_tiles(m.where(~C("large")).select("band", "c", "comp"), s).withColumn("large", F.lit(False))
    rows = rows.unionByName(by_tiles(split, s))
    longs = s.bits // 64
    brief = nodes.join(m.groupBy("c").agg(F.collect_list("band").alias("bands")), "c")  # as many as there are bands at most
    brief = common.written(brief.select("c", "n", "bands", bit_sketch(s)("text").alias("b")), "near-bits")
    brief = brief.select("c", "n", "bands", "b.own", *[C("b.bits")[i].alias(f"k{i}") for i in range(longs)])
    rows = common.written(rows.join(brief, "c"), "near-buckets")
    left, right = rows.where(~C("lead")), rows.where("home").select(*[C(x).alias(f"{x}_") for x in rows.columns])
    differ = sum((F.bit_count(C(f"k{i}").bitwiseXOR(C(f"k{i}_"))) for i in range(longs)), F.lit(0))
    near = (F.least("n", "n_") * den >= F.greatest("n", "n_") * num) & (differ <= most_differences(s))
    both = F.size(F.array_intersect("own", "own_"))
    sure = C("own").isNull() | C("own_").isNull() | (both * (num + den) >= (F.size("own") + F.size("own_")) * num)
    once = C("large") | (F.array_min(F.array_intersect("bands", "bands_")) == C("band"))
    meet = (C("large") == C("large_")) & (C("band") == C("band_")) & (C("at") == C("at_")) & (C("comp") != C("comp_")) & (C("lead_") | (C("c") < C("c_")))
    pairs = left.join(right, meet & near & once & sure)
    return pairs.select(F.least("c", "c_").alias("a"), F.greatest("c", "c_").alias("b")).distinct()


def group(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """key (of id and text), doc_id, n_shingles, component_id, comp of every row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and are linked with nothing; a text shorter than a shingle is one
    shingle. The component is the least id of all rows reachable; null ids do not count, and a
    component of null ids only has a null id. Ids may be null or repeated, so only ``comp``, a hash of a member's
    shingles, tells components apart (null without shingles). Repeated rows stay rows.
    """
    common.bound_batches(docs.sparkSession)
    src = docs.select("doc_id", "text", F.unhex(common.content_key(C("doc_id"), C("text"))).alias("key"))
    own = common.written(src.select("key", "doc_id", sketcher(s)("text").alias("s")).select("key", "doc_id", "s.*"), "near-sketches")
    nodes = own.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.min(F.struct("key", "n", "sig")).alias("x"))
    nodes = common.written(nodes.select("c", "least", "x.*"), "near-nodes")
    bands = nodes.select("c", F.explode(band_keys(s)("sig")).alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = common.written(bands.join(sizes, "band"), "near-members")
    wanted = nodes.join(members.select("c").distinct(), "c").select("c", "key", "n", "sig")
    texts = src.select("key", "text").join(wanted.select("key", "c", "n", "sig"), "key")
    able = texts.dropDuplicates(["key"]).select("c", "n", "sig", "text")
    able = common.written(able, "near-texts")
    seen = common.written(hub_pairs(members, s.hubs), "near-pairs")
    label = components(verify(seen, able, s))
    rest = common.written(cross_pairs(members, label, able, s).join(seen, ["a", "b"], "left_anti"), "near-pairs")
    more = verify(rest, able, s)
    joined = with_component(with_component(more, label, "a").withColumnRenamed("comp", "ca"), label, "b").select(
        C("ca").alias("a"), C("comp").alias("b")).where(C("a") != C("b"))
    top = components(joined)
    late = top.select("v", C("v").alias("mid")).join(label.select("v"), "v", "left_anti")  # linked in the second round only
    comp = with_component(label.select("v", C("comp").alias("mid")).unionByName(late), top, "mid").select("v", "comp")
    least = with_component(nodes.select("c", "least"), comp, "c")
    ids = common.written(least.groupBy("comp").agg(F.min("least").alias("component_id")), "near-components")
    by_node = common.written(least.join(ids, "comp").select("c", "component_id", "comp"), "near-classes")
    out = own.select("key", "doc_id", C("n").alias("n_shingles"), "c").join(by_node, "c", "left")
    return out.select("key", "doc_id", "n_shingles", F.when(C("n_shingles") == 0, C("doc_id")).otherwise(C("component_id")).alias("component_id"), "comp")


def deduplicate(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One document of each group, with its own columns; documents without words all stay.

    The row with the least (id, content key) of its component stays; of equal rows, one.
    """
    g = group(docs.select("doc_id", "text"), s)
    some = g.where("n_shingles > 0")
    stay = some.groupBy("comp").agg(F.min(F.struct(C("doc_id").isNull(), "doc_id", "key")).alias("x")).select(C("x.key").alias("_k"), F.lit(True).alias("_once"))
    stay = stay.union(g.where("n_shingles = 0").select("key", F.lit(False)).distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.unhex(common.content_key(C("doc_id"), C("text"))).alias("_k"))
    kept = packed.join(stay, "_k").withColumn("_u", F.when(C("_once"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return kept.dropDuplicates(["_k", "_u"]).select("doc.*")


def op9_near_dedup(docs: DataFrame, s: Settings = CONTRACT) -> DataFrame:
    out = group(docs.select("doc_id", "text"), s)
    return out.select("doc_id", "n_shingles", "component_id", C("doc_id").eqNullSafe(C("component_id")).alias("kept"))

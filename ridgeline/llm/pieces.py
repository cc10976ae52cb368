"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type encoding is the only sequence of pieces that covers the text and in
which every two neighbours are compatible: had the two been merged out of single
characters, no merge across their border would have come first. So no merges are
replayed over the text. An Aho-Corasick automaton gives the longest piece at every position; pieces are
taken longest first, each checked against its left neighbour by undoing the later merge of the two
step by step; where none fits, the position is marked in a bitfield as failed and the last piece is replaced by its next shorter prefix.

No piece crosses certain borders (after the blanks' mark, around characters that no
piece holds); the text is cut there, and the encoding of short parts is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLANK = "▁"  # fixed: the library's mark for a blank
KEEP, SHORT = 150_000, 48  # parts in each of the two generations that a task remembers, and their greatest length


class Pieces:
    """Tables of one model. Ranks order merges (equal scores share a rank, the left one first); single characters have rank -1."""

    def __init__(self, model: bytes):
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        self.end = sp.eos_id()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.byte)) or any(map(sp.is_unused, range(size))) or self.end < 0:
            raise ValueError("the model needs a piece for every byte, an end piece and no unused pieces")
        text = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        score = {p: sp.get_score(i) for p, i in text.items()}
        for c in set(chain.from_iterable(text)) - set(text):
            text[c] = size + ord(c)  # only within longer pieces; alone it falls back to bytes
        order = {s: k for k, s in enumerate(sorted({-s for s in score.values()}))}
        self.rank = {i: order[-score[p]] if len(p) > 1 else -1 for p, i in text.items()}
        self.length = {i: len(p) for p, i in text.items()}
        self.size = size
        self.build(text)
        self.cuts(text)
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def build(self, text: dict[str, int]) -> None:
        """Last merge of every piece, in the order of merges; a piece that no merge gives never occurs and is left out."""
        self.pair: dict[tuple[int, int], int] = {}
        self.split = {i: (i, i) for p, i in text.items() if len(p) == 1}
        for p, i in sorted(text.items(), key=lambda x: (self.rank[x[1]], len(x[0]))):
            for k in range(len(p) - 1, 0, -1):
                a, b = text.get(p[:k]), text.get(p[k:])
                if a in self.split and b in self.split and self.compatible(a, b):
                    self.pair[a, b], self.split[i] = self.rank[i], (a, b)
                    break
        self.shorter, self.automaton = {}, ahocorasick.Automaton()
        for p, i in text.items():
            if i in self.split:
                self.shorter[i] = next((text[p[:k]] for k in range(len(p) - 1, 0, -1) if text.get(p[:k]) in self.split), None)
                self.automaton.add_word(p[::-1], i)
        self.automaton.make_automaton()

    def cuts(self, text: dict[str, int]) -> None:
        used = set(chain.from_iterable(text))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in used)
        one = f"|[{alone}]" if alone else ""
        if any(BLANK in p.lstrip(BLANK) for p in text):
            self.parts = re.compile(f"[^{alone}]+{one}" if alone else ".+", re.S)
        else:
            self.parts = re.compile(f"{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+{one}")

    def neighbours(self, a: int, b: int) -> bool:
        """``compatible``, remembered."""
        ok = self.apart.get((a, b))
        if ok is None:
            if len(self.apart) >= KEEP:
                self.apart.clear()
            ok = self.apart[a, b] = self.compatible(a, b)
        return ok

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart when merged from single characters: the later merge of the two is undone until both are single."""
        rank, split, pair = self.rank, self.split, self.pair
        limit = len(rank)
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            x, y = rank[a], rank[b]
            if x > y:
                limit, a = x, split[a][1]  # a merge to the right of it comes first only by rank
            elif y >= 0:
                limit, b = y + 1, split[b][0]  # a merge to the left of it comes first also at equal rank
            else:
                return True

    def part(self, s: str) -> list[int]:
        n, longest = len(s), [None] * len(s)
        for end, i in self.automaton.iter(s[::-1]):  # reversed text, reversed pieces: matches that start at one position, longest first
            at = n - 1 - end
            if longest[at] is None:
                longest[at] = i
        out, at = [], 0
        while at < n:
            if longest[at] is None:
                out += self.bytes_of(s[at])
                at += 1
                continue
            stop = at
            while stop < n and longest[stop] is not None:
                stop += 1
            for i in self.run(longest, at, stop):
                if i < self.size:
                    out.append(i)
                else:
                    out += self.bytes_of(chr(i - self.size))
            at = stop
        return out

    def bytes_of(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8")]

    def run(self, longest: list[int], start: int, stop: int) -> list[int]:
        failed, taken, at, take = bytearray((stop - start >> 3) + 1), [], start, longest[start]
        length, shorter, neighbours = self.length, self.shorter, self.neighbours
        while at < stop:
            end = at + length[take] - start
            if not failed[end >> 3] >> (end & 7) & 1 and (not taken or neighbours(taken[-1], take)):
                taken.append(take)
                at = end + start
                take = longest[at] if at < stop else None
            elif shorter[take] is not None:
                take = shorter[take]
            else:
                failed[at - start >> 3] |= 1 << (at - start & 7)
                take = taken.pop()
                at -= length[take]
        return taken

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text as the library gives them, without begin and end."""
        known, out = self.known, []
        for s in self.parts.findall(self.library.normalize(text)):
            ids = known.get(s)
            if ids is None:
                ids = self.before.get(s) or self.part(s)
                if len(s) <= SHORT:
                    if len(known) >= KEEP:
                        self.before, self.known = known, {}
                        known = self.known
                    known[s] = ids
            out += ids
        return out


def checked_model(path: str) -> bytes:
    """The bytes of a model file on the driver. A model whose pieces the method would encode otherwise than the library is refused."""
    with open(path, "rb") as f:
        model = f.read()
    p = Pieces(model)
    pieces = [p.library.id_to_piece(i).replace(BLANK, " ") for i in range(p.size) if i in p.length]
    if any(p.encode(t) != ids for t, ids in zip(pieces, p.library.encode(pieces, num_threads=1), strict=True)):
        raise ValueError("not a merge-type model, or one with pieces of its users")
    return model


def encoder(spark: SparkSession, path: str):
    """Column function: text to struct(ids with the end id last, decoded text). Null counts as empty.

    The model (under ten megabytes, checked) is broadcast; its tables are built once a task.
    """
    model = checked_model(path)
    if len(model) > 10_000_000:
        raise ValueError("the model is too large to be broadcast")
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("ids array<int>, decoded string")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Pieces(shared.value)
        for batch in texts:
            ids = [[*p.encode(t or ""), p.end] for t in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [p.library.decode(i) for i in ids]}, columns=["ids", "decoded"])
    return encode


def decoder(spark: SparkSession, path: str):
    """Column function: array of ids to text, by the library's rules; null ids give null."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            yield pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in batch], dtype=object)
    return decode


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with columns ids and decoded after its own (own columns of those names are replaced).

    Null and empty texts have the end id only and decode to an empty text. Repeated rows stay rows, an
    empty table stays empty. A text of any length is encoded whole; memory follows its longest part without a border.
    """
    from .common import bound_batches

    bound_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("ids", "decoded")]
    got = docs.select(*[F.col(f"`{c}`") for c in own], encoder(docs.sparkSession, path)(F.col(text)).alias("ids"))
    return got.select(*[F.col(f"`{c}`") for c in own], F.col("ids.ids").alias("ids"), F.col("ids.decoded").alias("decoded"))


def digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op11_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    out = encode_documents(docs.select("doc_id", "text"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))

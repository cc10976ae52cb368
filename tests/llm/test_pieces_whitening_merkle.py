"""SentencePiece encoding against the library, whitening against a dense solver, Merkle proofs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ridgeline.llm import merkle, pieces, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.checked_model(MODEL))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab _\n▁-=é漢", max_size=60)))
def test_any_text_as_the_library(model, text):
    text = text.encode("utf-8", "ignore").decode()
    assert model.encode(text) == model.library.encode(text)


def test_piece_fragments_runs_and_long_parts(model):
    rnd = random.Random(2)
    names = [model.library.id_to_piece(i).replace("▁", " ") for i in model.length if i < model.size]
    cases = ["".join(rnd.choice(names)[:rnd.randrange(1, 9)] for _ in range(rnd.randrange(1, 15))) for _ in range(4000)]
    cases += [c * n for c in " a=-_▁\n" for n in range(70)] + ["the" + " " * n + "end" for n in range(40)]
    cases.append("".join(rnd.choice("abcdefghij+/=QWERTY") for _ in range(200_000)))
    assert [model.encode(t) for t in cases] == model.library.encode(cases, num_threads=1)


def test_failed_positions_are_left_for_good(model):
    """A chain of overlapping pieces makes the search go back; every position fails once at most, so the steps stay linear."""
    steps = []
    model.apart.clear()
    inner = model.neighbours
    model.neighbours = lambda a, b: steps.append(1) or inner(a, b)
    try:
        for n in (2000, 4000):
            steps.clear()
            model.part("ellellesse" * n)
            assert len(steps) < 60 * n
    finally:
        del model.neighbours


def test_encoded_documents(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " "), (None, "a\u0000b\t▁ 😀"), (-3, " ")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd)
    want = sorted((r.doc_id is None, r.doc_id or 0, [*model.library.encode(r.text or ""), 2]) for r in both.collect())
    got = pieces.encode_documents(both.selectExpr("*", "1 AS ids", "2 AS decoded"), MODEL)
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in rows) == want
    assert all(r.decoded == model.library.decode(list(r.ids)) for r in rows)
    assert [r[0] for r in got.select(pieces.decoder(spark, MODEL)("ids") == F.col("decoded")).distinct().collect()] == [True]
    q = {r.doc_id: r for r in pieces.op11_pieces(odd).collect()}
    assert q[-1].n_tokens == 1 and q[-1].ids_sha256 == hashlib.sha256(b"2").hexdigest() and q[-1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.op11_pieces(odd.limit(0)).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"nothing")
    with pytest.raises(Exception):
        pieces.checked_model(str(tmp_path / "m"))


def spectra():
    rnd = np.random.default_rng(0)
    q = np.linalg.qr(rnd.standard_normal((40, 40)))[0]
    yield "clustered", (q * np.r_[[5.0] * 7, np.linspace(1, 1 + 1e-9, 13), np.linspace(0.01, 0.5, 20)]) @ q.T
    yield "diagonal", np.diag(np.r_[3.0, 3, 3, 2, 1, 0.5, 0, 0])
    yield "steep", (q * np.logspace(0, -11, 40)) @ q.T
    yield "single", np.array([[2.0]])
    yield "two", np.array([[2.0, 1], [1, 2]])
    yield "rank one", np.outer(np.arange(9.0), np.arange(9.0))
    yield "wilkinson", np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)


@pytest.mark.parametrize("name,v", list(spectra()))
def test_leading_components(name, v):
    v = (v + v.T) / 2
    values, x = whitening.leading_components(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][:len(values)]
    assert np.allclose(values, want, rtol=1e-13, atol=4e-15 * want[0] * len(v))
    assert np.abs(x @ x.T - np.eye(len(x))).max() < 1e-13
    assert np.abs(v @ x.T - x.T * values).max() < 1e-13 * want[0] * len(v)
    assert len(values) == min(32, np.sum(np.linalg.eigvalsh(v) > 1e-12 * want[0]))


def test_whitening_against_dense_algebra(spark):
    t = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, []), (-3, [1.0] * 3), (-4, [None] + [1.0] * 63), (-5, [float("nan")] * 64), (-6, [float("inf")] * 64), (-7, [3e38] * 64),
                                 (None, [0.5] * 64), (-8, [0.5] * 64), (-8, [0.5] * 64)], "vec_id long, embedding array<float>")
    both = t.union(odd)
    rows = [r for r in both.collect() if r.embedding and len(r.embedding) == 64 and all(e is not None and np.isfinite(e) and abs(e) < 1e30 for e in r.embedding)]
    x = np.floor(64 * np.array([r.embedding for r in rows], dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    got = {}
    for r in whitening.op12_whitening(both.selectExpr("*", "1 AS _x", "2 AS deviation")).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert sum(map(len, got.values())) == 32 * n and len(got[-8, 1]) == 2
    for k in (1, 2, 17, 32):
        e, a = values[-k], axes[:, -k]
        want = y @ a / np.sqrt(e)
        sign = np.sign(want @ [got[r.vec_id, k][0].whitened for r in rows])
        assert np.allclose(sign * want, [got[r.vec_id, k][0].whitened for r in rows], atol=1e-9)
        assert abs(got[rows[0].vec_id, k][0].explained / (e / values.sum()) - 1) < 1e-10
    for r, v in zip(rows, x, strict=True):
        assert got[r.vec_id, 1][0].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
    assert 0 <= got[-8, 1][0].identity_error < 1e-9 and got[-8, 1][0].n == n


def test_vectors_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.op12_whitening(one).count() == whitening.op12_whitening(one.limit(0)).count() == 0
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted((r.component, round(abs(r.whitened), 9)) for r in whitening.op12_whitening(line).collect()) == [(1, 1.0), (1, 1.0)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of rows (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = nodes[i - i % 3:i - i % 3 + 3]
            out.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
            i //= 3
        return out
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    over = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            p = path(trees[s], i) + path(over, k)
            f = leaf(r, r[1].replace("\n", "")) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None else h
            for a, b in p:
                f = sha(a + f + b)
            out.append((r[0], h, trees[s][-1][0], over[-1][0], sha("".join(a + b for a, b in p)), f, f == over[-1][0]))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.op13_merkle(df).collect()), key=str)


def test_manifest_against_brute_force(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"t{i}\n{i % 7}\n", "en", "big" if i % 3 else f"s{i % 11}", i) for i in range(1500)]
    rows += [(None, None, None, None, None), (5, "", None, None, 0), (5, "", None, None, 0), (7, "é\n", "fr", "Ünï", 2), (8, None, "en", "lone", 3), (9, "x" * 300_000, "en", "", 1), (None, "a\nb", "en", "big", 1)]
    df = spark.createDataFrame(rows, schema)
    assert manifest_rows(df.selectExpr("*", "1 AS g", "2 AS pos", "3 AS hash", "4 AS m")) == brute(rows)
    one = spark.createDataFrame(rows[:1], schema)
    assert manifest_rows(one) == brute(rows[:1])
    assert merkle.op13_merkle(df.limit(0)).count() == 0


def test_manifest_of_three_stored_levels(spark):
    n = 3 ** (2 * merkle.LEVELS) + 500
    rows = [(i, f"{i}\n", None, "one", None) for i in range(n)]
    df = spark.range(n).selectExpr("id AS doc_id", "concat(id, '\n') AS text", "CAST(null AS string) AS lang", "'one' AS source", "CAST(null AS long) AS n_chars")
    assert manifest_rows(df) == brute(rows)

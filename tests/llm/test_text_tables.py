"""Edge cases that every text operator shares: nulls, empty and long texts, repeated rows, empty tables, clashing column names."""

import pytest

import corpus_pipeline
from ridgeline.llm import chat, decontaminate, html_extract, language_id, mixing, near_dedup, quality_rules, secrets, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("row", "doc", "_k", "_x", "key", "size", "h", "c", "n", "band", "t", "at", "hits", "n_hit", "contaminated", "lang_pred", "score", "shard", "slot",
         "copies", "taken", "component_id", "comp", "kept", "w", "text_crc32", "templates", "host", "main_text", "spans", "base", "target", "_s")
LONG = " ".join(f"word{i % 4999} the of" for i in range(40_000))


def rows():
    some = "the of and to in that it is was for on with as at by from are this " * 3
    return [(1, some + "alpha", "en", "a", 10), (2, some + "alpha", "en", "a", 10), (2, some + "alpha", "en", "a", 10), (3, None, None, None, None),
            (None, None, "en", "b", 0), (4, "", "en", None, 0), (5, " \n\t ", "fr", "b", 4), (None, "le la les des une et qui que dans sur pour par " * 4, "fr", "b", 9),
            (6, "le la les des une et qui que dans sur pour par " * 4 + "beta", "fr", "a", 9), (7, LONG, "en", "c", 1), (8, "1234 5678 ...", None, "c", 1),
            (9, "der die das und ist nicht ein zu " * 5, "de", "c", 1), (10, "𝔘nïcödé ﷺ 漢字 " * 20, "de", "c", 1)]


def documents(spark, extra=False, empty=False):
    df = spark.createDataFrame([] if empty else rows(), SCHEMA)
    return df.selectExpr("*", *[f"'x{i}' AS `{c}`" for i, c in enumerate(CLASH)]) if extra else df


def items(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i} the of" for i in range(10))), (2, None), (3, ""), (None, "漢字")], "item_id long, text string")


THIN = {"op1": quality_rules.op1_quality, "op2": suffix_dedup.op2_suffix, "op3": lambda d: decontaminate.op3_decontamination(d, items(d.sparkSession)),
        "op4": mixing.op4_mixing, "op5": secrets.op5_secrets, "op8": sharding.op8_sharding, "op9": near_dedup.op9_near_dedup, "op10": language_id.op10_language}


@pytest.mark.parametrize("name", THIN)
def test_digest_queries_on_odd_rows(spark, name):
    plain = [tuple(r) for r in THIN[name](documents(spark)).collect()]
    assert len(plain) == len(rows())
    assert sorted(map(str, plain)) == sorted(str(tuple(r)) for r in THIN[name](documents(spark, extra=True)).collect())
    assert THIN[name](documents(spark, empty=True)).collect() == []


def test_stages_on_odd_rows(spark):
    for extra in (False, True):
        docs = documents(spark, extra)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage_docs = docs
            if name == "decontamination":
                stage_docs = near_dedup.deduplicate(docs)
                out = decontaminate.clean_documents(stage_docs, items(spark))
            else:
                out = stage(spark, stage_docs, "")
            assert out.columns == docs.columns, name
            assert out.count() > 0
        last = sharding.shard_documents(docs)
        assert last.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
        assert last.count() == len(rows())
    none = documents(spark, empty=True)
    assert language_id.keep_identified(none).count() == near_dedup.deduplicate(none).count() == mixing.mix_documents(none).count() == 0
    assert sharding.shard_documents(none).count() == decontaminate.clean_documents(none, items(spark)).count() == 0


def test_pages_and_conversations_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (None, "http://a/x", "<p>a<p>b &amp; c"), (3, "http://A/y", "<article><h1>x</h1>" + "<p>y " * 3000)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.op6_html(pages.selectExpr("*", "1 AS row", "2 AS templates", "3 AS main_text", "4 AS host")).collect()}
    assert got[1] == got[2] == ("", 0) and got[None] == ("a b & c", 7) and got[3][0].startswith("x y y")
    assert html_extract.op6_html(pages.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, None, None), (1, None, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (None, 0, "assistant", "z" * 100_000)],
                                  "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.op7_chat(turns.selectExpr("*", "1 AS form", "2 AS t")).collect()}
    assert out[1].n_turns == 4 and out[None].loss_chars == 100_000 and out[-1].n_turns == 2
    assert [r.conv_id for r in chat.op7_chat(turns.limit(0)).collect()] == [-1]

"""Findings of the third round, queries on the cleaned splits: F12-F22."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewshift.functions import lexicon as lx
from reviewshift.functions import text as tx
from reviewshift.operators import cleaning, splits

SPACE = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
TEXTS = ["BRG @a_1 kotak   merah!!", "gk  Gk. (gk) gk,gk", "aaa!!!\n\n\nbb--cc---dd", "http:// https://x.y/z?a www. www.a.b c", "x&y 　z\x1f&",
         "a!!b..c???d----", "@www.a.b c #é1 #", "😀😀@d 𝐀@x𝐀# ❤❤❤", "éééa ΟΔΟΣ ΑΣ. İstanbul ñ'o", "...", "", "  ", "wkwk wkwkwk haaa ,,, ''", "@@@@a ## 12345 ٣٣٣ ²²²",
         "á́́b x​z \x00\x00\x00", "j&t-ok/cod ga-ada 'gak' tdk!tdk", *[f"kata{s}satu{s}{s}{s}gk{s}" for s in SPACE]]


def test_token_wise_cleaning_is_the_column_chain(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    for lexicon, whitelist in ((None, None), ({"GK": "Tidak&Ada", "brg": "", "kata": None, "": "x"}, ("brg ",)), ({}, ())):
        got = cleaning.clean_paths(df, ["i", "t"], "t", lexicon, whitelist).select(
            "*", tx.clean_text("t", False).alias("b"), tx.clean_text("t", True, lexicon, whitelist).alias("p")).collect()
        assert len(got) == len(TEXTS)
        assert [r for r in got if r["baseline"] != r["b"] or r["proposed"] != r["p"]] == []


def test_cleaning_does_not_depend_on_the_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string").coalesce(1)
    want = {r["i"]: r for r in cleaning.clean_paths(df, ["i"], "t").collect()}
    monkeypatch.setattr(cleaning, "CLEAN_BYTES", 64)
    assert {r["i"]: r for r in cleaning.clean_paths(df, ["i"], "t").collect()} == want


def test_the_paths_are_cleaned_without_regexes_a_text(spark):
    df = spark.createDataFrame([(1, "Brg bagus sekali, gk rusak!!"), (2, None), (3, "12345"), (4, "ok ya")], "id long, review_text string")
    out = splits.dual_path_clean(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_replace" not in plan
    assert sorted((r["id"], r["condition"], r["review_text"], r["review_text_clean"]) for r in out.collect()) == [
        (1, "baseline", "Brg bagus sekali, gk rusak!!", "brg bagus sekali, gk rusak!"),
        (1, "proposed", "Brg bagus sekali, gk rusak!!", f"{lx.SLANG_DICT['brg']} bagus sekali, tidak rusak!")]
    slim = splits.dual_path_clean(df, raw_text=False)
    assert slim.columns == ["id", "condition", "review_text_clean"] and slim.count() == 2
    assert out.filter(F.col("review_text_clean").isNull()).count() == 0

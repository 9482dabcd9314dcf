"""The five stages of a finished book, by hand."""

from docforge.functions import stages
from docforge.operators import lines


def after(spark, texts, stage):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.t for r in df.select("i", stages.finished(df["t"], stage).alias("t")).orderBy("i").collect()]


def test_paragraphs_lines_and_sentences_go(spark):
    got = after(spark, ["Ready\xa0for  next one", "Eat rice. Perfect choice! And\nsalt", "NEXT", "[Source page 12]\nTea", None, "", "The next module is here", "Copy it, paste it in word"], stages.DRAFT)
    assert got == [None, "Eat rice.\nAnd salt", None, "Tea", None, "", None, None]


def test_lines_of_talk_and_stars_go(spark):
    got = after(spark, ["Rice ⭐⭐ here\n\nmore.", "[SOURCE PAGE x\nTea is good.", "imperfect tea", "A perfect tea", "[page break]"], stages.ULTRA)
    assert got == ["Rice here more.", "Tea is good.", "imperfect tea", None, None]


def test_odd_paragraphs_go_from_the_third_stage(spark):
    assert after(spark, ["* ⭐ *", " ", "[PASTE END]", "[paste end]", "Tea.\n**\nKeep it printed always. Salt", "keep it printed"], stages.MERGED) == [None, None, "", "[paste end]", "Tea.\nSalt", None]


def test_pictures_and_praise_go(spark):
    assert after(spark, ["😀 Tea☕. Cook like a pro! Salt", "**", "Who this manual is for", "Who This Manual Is For you. x", ""], stages.CLEAN) == ["Tea.\nSalt", "", None, "x", ""]


def test_lists_of_sections_go(spark):
    assert after(spark, ["SECTION A - plan", "Section ab", "~~~", "Do you want tea? Yes.\n---\nSalt"], stages.READY) == [None, "Section ab", None, "Yes.\nSalt"]


def test_all_stages_in_turn_with_other_columns(spark):
    df = spark.createDataFrame([(1, "Tea. Awesome!", "a"), (2, "NEXT", "b"), (3, None, "c"), (4, "by Somebody. Rice", "d"), (5, "Awesome!", "e")], "_held int, text string, stage string")
    got = {r["_held"]: (r.text, r.stage) for r in lines.finish_book(df, custom=("by somebody",)).collect()}
    assert got == {1: ("Tea.", "a")}
    assert {r["_held"]: r.text for r in lines.finish_book(df).collect()} == {1: "Tea.", 4: "by Somebody.\nRice"}
    assert lines.finish_book(df.where("false")).count() == 0

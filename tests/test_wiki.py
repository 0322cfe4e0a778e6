import pytest
from pyspark.sql import functions as F

from weftwork.operators import wiki

CASES = [
    ("== B ==", "  1. B "), ("==== D ====", "#### D "), ("** b", "  - b"), ("*** c", "    - c"), ("[[Main_Page|home]]", "[home](/wiki/main-page)"), ("[[Basic Formal Ontology]]", "[Basic Formal Ontology](/wiki/basicformalontology)"),
    ("[http://a.b/c Foo]", "[Foo](http://a.b/c)"), ("[https://a.b/c Foo bar]", "[Foo bar](https://a.b/c)"), ("'''b'''", "**b**"), ("''i''", "*i*"), ("http://h/?a=1&b=2 x", "http://h/?a# 1&b2 x"), ("<pre>q</pre>", "```\nq\n```"),
    ("<code>a\nb</code>", "`a\nb`"), ("[[File:a|b|c]]", "[b|c](/wiki/filea)"), ("", ""),
    ('{| class="w"\n! A !! B\n|-\n| 1 || 2\n|}', "|  A  |  B |\n| --- | --- |\n|-\n| 1  |  2\n"),
]


@pytest.mark.parametrize(("raw", "want"), CASES)
def test_rules(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(wiki.markdown_body(F.col("s")).alias("r")).first().r == want


def test_pages(spark):
    got = {r.slug: r for r in wiki.wiki_to_markdown(spark.createDataFrame([("Main_Page", "* a"), ("No_Text", None)], "name string, raw string")).collect()}
    assert got["main-page"].markdown == "---\nid: main-page\ntitle: Main Page\n---\n\n- a" and got["no-text"].markdown is None


def test_nav_config_leaves_index_out(spark):
    got = wiki.nav_config(spark.createDataFrame([("b",), ("index",), ("a",)], "slug string")).first().config
    assert 'items: ["a","b"]' in got and got.count("index") == 1


def test_navigation_order(spark):
    pages = spark.createDataFrame([("b", 1, "x"), ("a", None, "y"), ("a", 2, "z"), ("a", 2, "w")], "category string, position int, slug string")
    assert [r.slug for r in wiki.navigation_order(pages).collect()] == ["w", "z", "y", "x"]


def test_lines_and_white_space_are_javascripts(spark):
    raw = "x\u0085* a\n*\ufeffb\u2028*\u0085c\n==\u3000T\u0085 =="
    got = spark.createDataFrame([("P", raw)], "name string, raw string").select(wiki.markdown_body(F.col("raw")).alias("m")).first().m
    assert got == "x\u0085* a\n- b\u2028*\u0085c\n  1. T\u0085 "


def test_list_rules_stop_at_marks_alone(spark):
    """The rules in use begin with their mark, and give what the written ones give."""
    assert all(used[0] in "\\#" and used != rule for (used, _), (rule, _) in zip(wiki._LISTS, wiki.LISTS, strict=True))
    starts = ["", "\n", "\r", " ", "\u0085", "x", "\U0001f600", "*", "#", " "]
    rows = [(a + mark * n + end,) for a in starts for mark in "*#" for n in range(1, 6) for end in (" b", "﻿b", "\n", "b", "", f" {mark} {mark}{mark} ")]
    s = F.col("s")
    assert spark.createDataFrame(rows, "s string").filter(wiki._apply(s, wiki._LISTS) != wiki._apply(s, wiki.LISTS)).count() == 0

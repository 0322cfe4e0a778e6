import datetime
import re

import pytest
from pyspark.sql import functions as F

from weftwork.functions import scalars as S


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(("text", "want"), [("\t a  ", "a"), ("", ""), ("\n\n", ""), ("a b", "a b"), (None, None)])
def test_trim_strips_all_white_space(spark, text, want):
    assert one(spark, S.js_trim(F.col("s")), s=text) == want


@pytest.mark.parametrize(("text", "want"), [("a.md.md", "a.md"), (".md", ""), ("none", "none"), ("x.mdy.md", "xy.md")])
def test_replace_first_only(spark, text, want):
    assert one(spark, S.replace_first(F.col("s"), ".md", ""), s=text) == want


@pytest.mark.parametrize(("i", "j", "want"), [(1, 3, "bc"), (3, 1, "bc"), (-5, 2, "ab"), (2, 99, "cde"), (4, 4, "")])
def test_substring_swaps_and_clamps(spark, i, j, want):
    assert one(spark, S.js_substring(F.col("s"), F.col("i"), F.col("j")), s="abcde", i=i, j=j) == want


def test_small_rules(spark):
    assert one(spark, S.utf16_length(F.col("s")), s="a\U0001f600é") == 4
    assert one(spark, S.text_plus(F.col("s"), F.lit("x")), s=None) == "nullx"
    assert one(spark, S.falsy_or(F.col("s"), F.lit("d")), s="") == "d"
    assert one(spark, S.first_filled(F.lit(""), F.col("s"), F.lit("z")), s=None) == "z"
    assert one(spark, S.slug(F.col("s")), s="Basic_Formal_Ontology_2.0") == "basic-formal-ontology-20"
    assert one(spark, S.slug(F.col("s")), s="Main_Page#Events") == "main-pageevents"
    assert one(spark, S.dash_slug(F.col("s")), s="A  b C.d") == "a-b-c.d"
    assert one(spark, S.js_split(F.col("s"), "||"), s="a||b||") == ["a", "b", ""]
    assert one(spark, S.without(F.col("a"), F.lit("x")), a=["x", "y", "x", None]) == ["y", None]
    assert one(spark, S.inner_items(F.col("a")), a=["x"]) == [] and one(spark, S.inner_items(F.col("a")), a=["a", "b", "c"]) == ["b"]
    assert one(spark, S.has_items(F.split("a", ",")), a=None) is False
    assert one(spark, S.replace_matches(F.col("s"), "\\[(a+)\\]", lambda m: F.upper(m)), s="[a] x [aa] [b]") == "[A] x [AA] [b]"
    assert one(spark, S.is_internal(F.col("s")), s="/a") is True


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www.youtube.com/watch?v=abcdefghijk&t=1", "abcdefghijk"), ("https://youtu.be/abcdefghijk", "abcdefghijk"), ("https://youtu.be/short", None), ("https://example.org", None)],
)
def test_video_id(spark, url, want):
    assert one(spark, S.video_id(F.col("u")), u=url) == want


def test_slug_is_idempotent(spark):
    rows = spark.createDataFrame([("A_b c!é",), ("--X__",), ("",)], "s string").select(S.slug(F.col("s")).alias("a")).select("a", S.slug(F.col("a")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_current_time_year_and_headers(spark):
    before = datetime.datetime.now(datetime.UTC)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        r = spark.range(1).select(S.now_iso().alias("iso"), S.now_millis().alias("ms"), S.now_millis(1).alias("next"), S.current_year().alias("year"), S.header_map({"Accept": "text/plain", "Id": F.col("id").cast("string")}).alias("h")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    after = datetime.datetime.now(datetime.UTC)
    told = datetime.datetime.fromisoformat(r.iso)
    assert r.iso.endswith("Z") and before - datetime.timedelta(milliseconds=1) <= told <= after
    assert r.ms == round(told.timestamp() * 1000) and r.next == r.ms + 1
    tokyo = datetime.timezone(datetime.timedelta(hours=9))
    assert r.year in {before.astimezone(tokyo).year, after.astimezone(tokyo).year} and r.h == {"Accept": "text/plain", "Id": "0"}


def test_choices_with_nulls(spark):
    rows = spark.createDataFrame([(1, " a ", None, "x"), (2, " ", False, "y"), (3, None, True, None), (4, "b", True, "z")], "id int, text string, flag boolean, name string")
    form = F.create_map(F.lit("x"), F.lit("0"))
    got = rows.select("id", S.sendable(F.col("text"), F.col("flag")).alias("s"), S.by_flag(F.col("flag"), F.lit("yes"), F.lit("no")).alias("f"), S.lookup(F.col("name"), {"x": "1", "y": "2"}).alias("l"), S.with_field(form, F.col("name"), F.col("text")).alias("m"))
    assert [tuple(r)[1:] for r in got.orderBy("id").collect()] == [
        (True, "no", "1", {"x": " a "}), (False, "no", "2", {"x": "0", "y": " "}), (False, "yes", None, {"x": "0"}), (False, "yes", None, {"x": "0", "z": "b"}),
    ]


@pytest.mark.parametrize(("text", "want"), [("\u0085 a \u0085", "\u0085 a \u0085"), ("\ufeff\u00a0a\u3000\u2028", "a"), (" a\u0085 ", "a\u0085"), ("\x1ca\x1c", "\x1ca\x1c"), ("\u180ea", "\u180ea")])
def test_trim_by_javascripts_white_space(spark, text, want):
    assert one(spark, S.js_trim(F.col("s")), s=text) == want


def units(text, a, b):
    """JavaScript's substring by UTF-16 code units, halves as U+FFFD."""
    raw = text.encode("utf-16-le")
    n = len(raw) // 2
    a, b = sorted((max(0, min(a, n)), max(0, min(b, n))))
    return raw[2 * a : 2 * b].decode("utf-16-le", "replace")


def test_substring_and_index_by_utf16_units(spark):
    texts = ["\U0001f600abc", "a\U0001f600\U0001f601b", "\U0001f600", "", "plain", "é\U00010000é"]
    cases = [(t, a, b) for t in texts for a in range(-1, 7) for b in range(-1, 7)]
    df = spark.createDataFrame(cases, "s string, a int, b int").select("*", S.js_substring(F.col("s"), F.col("a"), F.col("b")).alias("r"), S.js_substring(F.col("s"), F.col("a")).alias("tail"), S.index_of(F.col("s"), "b").alias("i"))
    for r in df.collect():
        assert r.r == units(r.s, r.a, r.b), (r.s, r.a, r.b)
        assert r.tail == units(r.s, r.a, 99)
        assert r.i == (len(r.s[: r.s.index("b")].encode("utf-16-le")) // 2 if "b" in r.s else -1)
    assert one(spark, S.dash_slug(F.col("s")), s="A\ufeffB\u0085C\u2003 d") == "a-b\u0085c-d"


def test_texts_are_walked_natively(spark):
    """Every pair of ends against Python's own UTF-16; a whole text is neither split into characters nor matched at each."""
    text = "﻿\u0085\U0001f600a\U0001f601é　"
    raw = text.encode("utf-16-be")
    n = len(raw) // 2

    def part(i, j):
        low, high = sorted((min(i, n), min(j, n)))
        return re.sub("[\ud800-\udfff]", "�", raw[2 * low : 2 * high].decode("utf-16-be", "surrogatepass"))

    ends = spark.createDataFrame([(text, i, j) for i in range(n + 2) for j in range(n + 2)], "s string, i int, j int")
    for r in ends.select("i", "j", S.js_substring(F.col("s"), F.col("i"), F.col("j")).alias("r"), S.utf16_length(F.col("s")).alias("n")).collect():
        assert (r.r, r.n) == (part(r.i, r.j), n), (r.i, r.j)
    spaces = "\t\n\x0b\f\r \xa0       　﻿"
    assert one(spark, S.js_trim(F.col("s")), s=f"{spaces}\u0085 x ᠎{spaces}") == "\u0085 x ᠎"
    s = F.col("s")
    for made in (S.js_trim(s), S.utf16_length(s), S.js_substring(s, F.lit(4), F.lit(9)), S.index_of(s, "x")):
        assert "regexp_replace" not in str(made) and "split" not in str(made) and "aggregate" not in str(made)

import json

from pyspark.sql import functions as F

from weftwork.operators import messages as M
from weftwork.operators import quality as Q
from weftwork.plans import queries as plans


def test_drop_transient_keeps_null(spark):
    rows = spark.createDataFrame([(1, None), (2, True), (3, False), (4, True)], "seq int, is_typing boolean")
    assert {r.seq for r in M.drop_transient(rows).collect()} == {1, 3}


def test_segments(spark):
    texts = ["", "plain", "[a](b)", "x [a](b) y", "[a](b)[c](d)", "[a](b) end"]
    got = {}
    for r in M.link_segments(spark.createDataFrame([(t, t) for t in texts], "id string, text string")).orderBy("pos").collect():
        got.setdefault(r.id, []).append((r.kind, r.text, r.target))
    assert got == {
        "": [("text", "", None)], "plain": [("text", "plain", None)], "[a](b)": [("link", "a", "b")], "x [a](b) y": [("text", "x ", None), ("link", "a", "b"), ("text", " y", None)],
        "[a](b)[c](d)": [("link", "a", "b"), ("link", "c", "d")], "[a](b) end": [("link", "a", "b"), ("text", " end", None)],
    }


def answers(spark, *raws):
    return [r.a for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").orderBy("i").select(M.answer_text(F.col("raw")).alias("a")).collect()]


def test_answer_text_by_each_way(spark):
    assert answers(
        spark,
        "event: message data: hello event: done data: [DONE]",
        "event: message data:event: done data:",
        "map_intent I don't know what to do with this prompt. hi  there [DONE]",
        "data: first one\ndata: SYSTEM MESSAGE x\ndata: abcd\ndata: abcde\ndata: [DONE] no",
        "map_intent  a  b [DONE]",
    ) == ["hello", "", "hi  there", "first one abcde", "a b"]


def test_reversed_marks_change_places(spark):
    raw = "event: done data: x event: message data: y"
    start, end = raw.index(M.MESSAGE_MARK) + len(M.MESSAGE_MARK), raw.index(M.DONE_MARK)
    assert answers(spark, raw) == [raw[end:start].strip()]


def test_reply_content(spark):
    raws = ['{"message":"","content":"c"}', '{"text":"t","content":null}', '{"other":1}', "no json"]
    got = [r.a for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").orderBy("i").select(M.reply_content(F.col("raw")).alias("a")).collect()]
    assert got == ["c", "t", '{"other":1}', "no json"]


def test_reply_fields_on_all_events(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        # by event_id % 3: a message, a content, neither; to_json omits nulls
        field = {0: r.event_type, 1: None if r.user_id is None else str(r.user_id), 2: None}[r.event_id % 3]
        whole = {"message": r.event_type if r.event_id % 3 == 0 else "", "content": None}
        want[r.event_id] = field or json.dumps({k: v for k, v in whole.items() if v is not None}, separators=(",", ":"))
    got = plans.QUERIES["reply_fields"](spark, sf).collect()
    assert len(got) == len(want) and {r.event_id: r.reply for r in got} == want
    assert '{"message":""}' in want.values()


def test_event_payloads(spark):
    raw = "event: message\ndata: a\ndata: b\n\nevent: ping\ndata: no\n\nevent: message\ndata: [DONE]\n\nevent: message\ndata:  \n\nevent: message\ndata: SYSTEM MESSAGE z\n\nevent: message\ndata: c"
    assert spark.createDataFrame([(raw,)], "raw string").select(M.event_payloads(F.col("raw")).alias("p")).first().p == ["a\nb", "c"]


EVENTS = [(1, 1, "ask", "user", "q1"), (1, 2, "ask", "user", "q2"), (1, 3, "answer", "assistant", "a"), (1, 4, "ask", "user", "q3"), (2, 1, "ask", "user", "old"), (2, 2, "reset", None, None), (2, 3, "ask", "user", "new"), (2, 4, "error", "assistant", "sorry")]
SCHEMA = "conv_id long, seq long, kind string, role string, text string"


def test_replay(spark):
    got = sorted((r.conv_id, r.seq, r.role, r.text, bool(r.is_typing)) for r in M.replay(spark.createDataFrame(EVENTS, SCHEMA)).collect())
    assert got == [(1, 1, "user", "q1", False), (1, 2, "user", "q2", False), (1, 3, "assistant", "a", False), (1, 4, "assistant", "", True), (1, 4, "user", "q3", False), (2, 3, "user", "new", False), (2, 4, "assistant", "sorry", False)]
    assert [(r.conv_id, r.seq) for r in M.overlapping_asks(spark.createDataFrame(EVENTS, SCHEMA)).collect()] == [(1, 2)]


def test_rules(spark):
    rows = spark.createDataFrame([(1, "user", "x"), (2, "robot", None), (3, None, "y")], "id int, role string, text string")
    got = {(r.id, r.rule) for r in Q.violations(rows, ["id"], [Q.required("role"), Q.one_of("role", M.ROLES), Q.required("text")]).collect()}
    assert got == {(2, "role in domain"), (2, "text required"), (3, "role required")}
    good, bad = Q.set_aside(rows, F.col("role") == "user", "not a user")
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"not a user"}
    assert {r.id for r in M.roles_outside(rows).collect()} == {2, 3}


def test_lines_are_measured_in_utf16_units(spark):
    raw = "data: \U0001f600\U0001f600\U0001f600\ndata: abcd\ndata: abcde\ndata: \ufeff\u3000     \ndata: \u0085    "
    got = spark.createDataFrame([(raw,)], "raw string").select(M.data_lines(F.col("raw")).alias("a")).first().a
    assert got == ["\U0001f600\U0001f600\U0001f600", "abcde", "\u0085"]
    assert answers(spark, "\U0001f600event: message data: \ufeffhi\u0085 event: done data:") == ["hi\u0085"]
    assert answers(spark, "event: x\u0085data: a\u0085 b\ufeff c") == ["a\u0085 b c"]

"""The message log as a stream: late, repeated and torn batches give what replay gives over all events."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from weftwork.operators import messages as M
from weftwork.streaming import messages as S


def feed(spark, home, rows, **kw):
    spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").json(f"{home}/in")
    stream = spark.readStream.schema(S.EVENTS).json(f"{home}/in")
    S.keep_state(spark, stream, f"{home}/out", f"{home}/state", **kw).awaitTermination()


def log(df):
    rows = [tuple(r) for r in df.select("conv_id", "seq", "role", "text", "is_typing").collect()]
    return sorted(rows, key=str)


def test_late_and_repeated_batches_equal_replay(spark, tmp_path):
    rng = random.Random(11)
    rows = [(c, s, rng.choices(["ask", "answer", "error", "reset", "note"], [5, 4, 1, 1, 1])[0], "user", f"{c}.{s}") for c in range(6) for s in range(25)]
    rows = [(c, s, k, {"ask": "user", "reset": None}.get(k, "assistant"), t) for c, s, k, _, t in rows]
    mixed = rng.sample(rows, len(rows))
    batches = [mixed[:50], mixed[50:100], mixed[20:70], mixed[100:], mixed[:50]]
    want = log(M.replay(spark.createDataFrame(rows, S.EVENTS)))
    for n, batch in enumerate(batches):
        feed(spark, tmp_path, batch, patience_ms=86_400_000)
        if n == 1:
            assert S.compact(spark, str(tmp_path / "out")) == 1
            so_far = log(S.current(spark, str(tmp_path / "out")))
            assert so_far == log(M.replay(spark.createDataFrame(mixed[:100], S.EVENTS)))
    assert log(S.current(spark, str(tmp_path / "out"))) == want
    # a batch that is run again replaces its own folder
    last = spark.read.parquet(str(tmp_path / "out" / "changes" / "batch=3"))
    assert last.count() > 0
    assert S.compact(spark, str(tmp_path / "out")) >= 3
    assert log(S.current(spark, str(tmp_path / "out"))) == want


def test_the_clock_ends_questions(spark, tmp_path):
    feed(spark, tmp_path, [(1, 0, "ask", "user", "q"), (2, 0, "ask", "user", "x"), (2, 1, "answer", "assistant", "y"), (None, 0, "ask", "user", "lost"), (3, None, "ask", "user", "lost"), (3, 0, None, "user", "lost")], patience_ms=1)
    assert [r for r in log(S.current(spark, str(tmp_path / "out"))) if r[4]] == [(1, 0, "assistant", "", True)]
    feed(spark, tmp_path, [(9, 0, "note", "system", "tick")], patience_ms=1)
    got = log(S.current(spark, str(tmp_path / "out")))
    assert (1, 0, "assistant", S.NO_REPLY, None) in got and not any(r[4] for r in got)
    feed(spark, tmp_path, [(1, 1, "answer", "assistant", "late, but kept"), (1, 0, "ask", "user", "q")], patience_ms=1)
    assert [r[3] for r in log(S.current(spark, str(tmp_path / "out"))) if r[0] == 1] == [S.NO_REPLY, "q", "late, but kept"]
    feed(spark, tmp_path, [(1, 5, "reset", None, None)], patience_ms=1)
    assert {r[0] for r in log(S.current(spark, str(tmp_path / "out")))} == {2, 9}


def test_state_holds_no_texts(spark):
    schema = [f.name for f in spark.createDataFrame([], S.CHANGES).schema]
    assert schema[:3] == ["conv_id", "seq", "slot"]
    assert S.changes(spark.readStream.format("rate").load().select(F.lit(1).cast("long").alias("conv_id"), F.col("value").alias("seq"), F.lit("ask").alias("kind"), F.lit("user").alias("role"), F.lit("t").alias("text")), 10).isStreaming


class Held:
    """A state that counts the calls that go to Spark's process."""

    def __init__(self, calls):
        self.calls, self.map, self.value = calls, {}, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            elif name == "getValue":
                return self.map.get(args[0])
            elif name == "updateValue":
                self.map[args[0]] = args[1]
            elif name == "removeKey":
                del self.map[args[0]]
            elif name == "containsKey":
                return args[0] in self.map
            elif name == "keys":
                return iter(list(self.map))
            elif name == "iterator":
                return iter(list(self.map.items()))
            return 0

        return call


def test_a_batch_reads_and_writes_a_conversation_once():
    calls = []
    handle = Held(calls)
    handle.getValueState = handle.getMapState = lambda *_: Held(calls)
    step = S.Conversations(1000)
    step.init(handle)

    def batch(*rows):
        calls.clear()
        return [tuple(r)[1:4] for r in step.handleInputRows((7,), iter([Row(seq=n, kind=kind, role="user", text="t") for n, kind in rows]), handle)]

    assert batch(*[(n, "note") for n in range(100)]) == [(n, S.SAID, True) for n in range(100)] and len(calls) == 2
    assert batch(*[(n, "note") for n in range(100)]) == [] and len(calls) == 1
    far = [-3, 600, 5000]  # numbers of other blocks are kept too
    assert batch(*[(n, "note") for n in far]) == [(n, S.SAID, True) for n in far]
    assert batch(*[(n, "note") for n in far]) == []
    assert batch((601, "reset")) == [(n, S.SAID, False) for n in [-3, *range(100), 600]]
    assert batch((600, "note"), (5000, "note"), (602, "ask")) == [(602, S.SAID, True), (602, S.WAITS, True)]
    assert batch((603, "answer")) == [(603, S.SAID, True), (602, S.WAITS, False)]
    assert batch((9000, "reset")) == [(n, S.SAID, False) for n in (602, 603, 5000)]


def test_long_conversations_equal_replay(spark, tmp_path):
    """Numbers of several blocks, some below 0, with resets among them."""
    rng = random.Random(5)
    rows = [(c, s, rng.choices(["ask", "answer", "reset", "note"], [5, 3, 1, 5])[0], "user", f"{c}.{s}") for c in range(3) for s in rng.sample(range(-2000, 4000), 60)]
    rows = [(c, s, k, {"ask": "user", "reset": None}.get(k, "assistant"), t) for c, s, k, _, t in rows]
    for part in (rows[:90], rows[60:120], rows[120:]):
        feed(spark, tmp_path, rng.sample(part, len(part)), patience_ms=86_400_000)
    assert log(S.current(spark, str(tmp_path / "out"))) == log(M.replay(spark.createDataFrame(rows, S.EVENTS)))

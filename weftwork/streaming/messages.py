"""The message log as a stream with keyed state.

Events (conv_id, seq, kind, role, text) come in any order, late or repeated. The state of a conversation says which of its messages are live
and which questions are open, by number and without texts, so it stays small however long the texts are. A batch puts out what it changes:
rows that come and rows that go. The sink keeps a folder a batch, and a batch that is run again replaces its own folder. The log as it stands is the
last change of each row; it equals `replay` over all events, beside what the clock ended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "conv_id long, seq long, kind string, role string, text string"
#: slot tells the rows of one event apart: what was said, the placeholder of an open question, and the reply that the clock gave.
CHANGES = "conv_id long, seq long, slot string, live boolean, role string, text string, nth long"
SAID, WAITS, LATE = "said", "waits", "late"
NO_REPLY = "No reply came in time."
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Changes by the clock follow those of the batch's events.
_AFTER = 1 << 40
#: Numbers of messages that one entry of the state tells of.
_BLOCK = 512
_Change = Row("conv_id", "seq", "slot", "live", "role", "text", "nth")


def _bits(raw: bytes | None) -> int:
    return int.from_bytes(raw or b"", "little")


def _raw(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def _numbers(block: int, bits: int) -> Iterator[int]:
    """The numbers of a block whose bits are set."""
    while bits:
        low = bits & -bits
        yield block * _BLOCK + low.bit_length() - 1
        bits ^= low


class Live:
    """Numbers of the live messages, and which of them the clock replied to, as two bitmaps a block. Block 0 comes with the conversation's head, others are read when they are asked for."""

    def __init__(self, blocks, live: bytes | None, late: bytes | None):
        self.blocks, self.known, self.changed = blocks, {0: [_bits(live), _bits(late)]}, set()

    def _at(self, seq: int) -> tuple[int, int, list[int]]:
        block, bit = divmod(seq, _BLOCK)
        if block not in self.known:
            self.known[block] = [_bits(raw) for raw in self.blocks.getValue((block,)) or (None, None)]
        return block, 1 << bit, self.known[block]

    def holds(self, seq: int) -> bool:
        _, bit, (live, _) = self._at(seq)
        return bool(live & bit)

    def add(self, seq: int, late: bool = False) -> None:
        block, bit, both = self._at(seq)
        both[0] |= bit
        if late:
            both[1] |= bit
        self.changed.add(block)

    def take_before(self, seq: int) -> Iterator[tuple[int, bool]]:
        """Takes out the numbers before seq, each with whether the clock replied."""
        upto, bit = divmod(seq, _BLOCK)
        for block in sorted({*self.known, *[k[0] for k in self.blocks.keys()]}):  # noqa: SIM118  a state, no dict
            if block <= upto:
                both = self._at(block * _BLOCK)[2]
                gone = both[0] & ((1 << bit) - 1) if block == upto else both[0]
                late = gone & both[1]
                if gone:
                    self.known[block] = [both[0] & ~gone, both[1] & ~gone]
                    self.changed.add(block)
                for k in _numbers(block, gone):
                    yield k, bool(late >> (k - block * _BLOCK) & 1)

    def keep(self) -> tuple[bytes, bytes]:
        """Writes the blocks that changed and returns block 0."""
        for block in self.changed - {0}:
            live, late = self.known[block]
            if live:
                self.blocks.updateValue((block,), (_raw(live), _raw(late)))
            elif self.blocks.containsKey((block,)):
                self.blocks.removeKey((block,))
        return _raw(self.known[0][0]), _raw(self.known[0][1])


class Conversations(StatefulProcessor):
    """One conversation's state: head (last reset, last reply, how many questions are open, live messages of block 0), blocks (live messages of other blocks), open (seq to deadline).

    Each call of a state goes to Spark's process and back, so a batch reads and writes a short conversation's head once, however many events it has.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "reset long, reply long, waiting long, live binary, late binary")
        self.blocks = handle.getMapState("blocks", "block long", "live binary, late binary")
        self.open = handle.getMapState("open", "seq long", "deadline long")

    def _ended(self, upto: int) -> list[int]:
        """Closes the open questions before upto."""
        old = [k[0] for k in self.open.keys() if k[0] < upto]  # noqa: SIM118  a state, no dict
        for seq in old:
            self.open.removeKey((seq,))
        return old

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        conv = int(key[0])
        before = self.head.get() or (None, None, 0, None, None)
        reset, reply, waiting = before[:3]
        live, deadline, nth = Live(self.blocks, *before[3:]), None, 0

        def gone(seq: int, slot: str) -> Row:
            nonlocal nth
            nth += 1
            return _Change(conv, seq, slot, False, None, None, nth - 1)

        def came(seq: int, slot: str, role: str | None, text: str | None) -> Row:
            nonlocal nth
            nth += 1
            return _Change(conv, seq, slot, True, role, text, nth - 1)

        for row in rows:
            seq, kind = row["seq"], row["kind"]
            if (reset is not None and seq <= reset) or (kind != "reset" and live.holds(seq)):
                continue  # what a reset dropped, or what came before
            ends = kind == "reset"
            if kind == "reset":
                reset = seq
                for k, late in live.take_before(seq):
                    yield gone(k, SAID)
                    if late:
                        yield gone(k, LATE)
            else:
                live.add(seq)
                yield came(seq, SAID, row["role"], row["text"])
                if kind == "ask" and (reply is None or seq > reply):
                    if deadline is None:
                        deadline = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
                        self.handle.registerTimer(deadline)
                    self.open.updateValue((seq,), (deadline,))
                    waiting += 1
                    yield came(seq, WAITS, "assistant", "")
                elif kind in ("answer", "error") and (reply is None or seq > reply):
                    reply, ends = seq, True
            if ends and waiting:
                old = self._ended(seq)
                waiting -= len(old)
                for k in old:
                    yield gone(k, WAITS)
        after = (reset, reply, waiting, *live.keep())
        if after != tuple(before):
            self.head.update(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        conv, now, nth = int(key[0]), expiredTimerInfo.getExpiryTimeInMs(), _AFTER
        late = [k[0] for k, v in self.open.iterator() if v[0] <= now]
        if not late:
            return
        reset, reply, waiting, *block = self.head.get()
        live = Live(self.blocks, *block)
        for seq in late:
            self.open.removeKey((seq,))
            live.add(seq, late=True)
            yield _Change(conv, seq, WAITS, False, None, None, nth)
            yield _Change(conv, seq, LATE, True, "assistant", NO_REPLY, nth + 1)
            nth += 2
        self.head.update((reset, reply, waiting - len(late), *live.keep()))

    def close(self) -> None:
        pass


def changes(events: DataFrame, patience_ms: int) -> DataFrame:
    """The changes that a stream of events makes. Events without conv_id, seq or kind are none."""
    known = events.filter("conv_id IS NOT NULL AND seq IS NOT NULL AND kind IS NOT NULL").select("conv_id", "seq", "kind", "role", "text")
    return known.groupBy("conv_id").transformWithState(Conversations(patience_ms), CHANGES, "Append", "ProcessingTime")


def keep_state(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, patience_ms: int = 600_000, available_now: bool = True) -> StreamingQuery:
    """Starts a query that turns a stream of events into changes below path.

    With available_now it takes what has come and ends; questions out of time are then ended by the next batch that has events. A question without reply for patience_ms of the clock is ended by a reply of the clock's own (slot late); a later answer is
    kept beside it. Of events that share conv_id and seq the first to come counts. An event before the conversation's last reset is dropped.
    State is kept by RocksDB, with numbers only; all rows of one conversation in a batch pass through one task, a part at a time.
    """

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    # by the clock alone a query is never done, so one that ends with its input runs no batch without events
    wanted = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str(not available_now).lower()}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        writer = changes(events, patience_ms).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _last(rows: DataFrame) -> DataFrame:
    """The last change of each row; keys spread even where one conversation holds most rows, and each task keeps one change a key before the shuffle."""
    newest = F.max_by(F.struct("live", "role", "text"), F.struct("batch", "nth")).alias("_row")
    return rows.groupBy("conv_id", "seq", "slot").agg(newest).select("conv_id", "seq", "slot", "_row.*")


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches up to which there are compacted states; one small file name each."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [(f.getPath().getName(), fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f.getPath()}/_SUCCESS"))) for f in fs.listStatus(folder)]
    return sorted(int(name.partition("=")[2]) for name, whole in found if whole)


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest compacted state and the changes after it, as rows with batch and nth; and the base's number."""
    base = max(_bases(spark, path), default=-1)
    new = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{path}/changes").filter(F.col("batch") > base)
    if base >= 0:
        old = spark.read.schema(CHANGES).parquet(f"{path}/base/upto={base}").withColumn("batch", F.lit(base).cast("long"))
        new = new.unionByName(old)
    return new, base


def current(spark: SparkSession, path: str) -> DataFrame:
    """The log as it stands: conv_id, seq, role, text, is_typing, slot. It reads the newest compacted state and the changes after it."""
    rows = _last(_rows(spark, path)[0]).filter("live")
    return rows.select("conv_id", "seq", "role", "text", F.when(F.col("slot") == WAITS, F.lit(True)).alias("is_typing"), "slot")


def compact(spark: SparkSession, path: str) -> int:
    """Writes the log as it stands as a new base; later reads start there. Returns the last batch in it, -1 if there is none. Not while a batch is written."""
    rows, base = _rows(spark, path)
    last = rows.agg(F.max("batch")).first()[0]
    if last is None or last == base:
        return base
    _last(rows).filter("live").withColumn("nth", F.lit(-1).cast("long")).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    return last

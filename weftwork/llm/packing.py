"""Mixture-controlled packing of documents into training sequences.

Each source is a queue of its documents' tokens in the order of doc_id. Windows of `window` tokens are filled by deficit
round-robin: every window adds its quantum (the window's tokens times the source's share) to the
deficit of each source, the source puts as many whole tokens as its deficit holds, and the rest, less than one token,
is carried into the next window. When a queue runs dry the others share its part by their weights. A deficit after j
windows depends on j alone, so any partition finds the place of its tokens from the totals and no state has to be handed on.
Documents are cut where a quantum or a sequence ends; all sequences but the last are full.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import cut, read_table, running_sum
from weftwork.llm.tokens import default_tokenizer, encoder
from weftwork.llm.words import slices

END, SEQUENCE = 2, 4096
#: Sequences of a window.
WINDOW = 64
#: Target token proportions of the query by source, which are not those of the corpus: queues run dry one after the other.
WEIGHTS: Mapping[str, int] = {f"src{k}": 1 + k % 3 for k in range(20)}


class MixPlan:
    """Which tokens of each source's queue each window takes. Sources without a weight get 0 until only such are left."""

    def __init__(self, totals: Mapping[str, int], weights: Mapping[str, int] | None, window: int):
        self.names = sorted(s for s, n in totals.items() if n > 0)
        self.index = {s: k for k, s in enumerate(self.names)}
        self.totals, self.window = [totals[s] for s in self.names], window
        self.windows = -(-sum(self.totals) // window)
        share = self.totals if weights is None else [int(weights.get(s, 0)) for s in self.names]
        self.starts: list[Fraction] = []  # of phases, in tokens
        self.lines: list[list[tuple[int, int, int]]] = []  # (a, b, d) of each phase and source: (a + b x) / d taken at x
        x, done, left = Fraction(0), [Fraction(0)] * len(self.names), set(range(len(self.names)))
        while left:
            w = {s: share[s] for s in left if share[s] > 0} or {s: self.totals[s] for s in left}
            whole = sum(w.values())
            self.starts.append(x)
            self.lines.append([])
            for s in range(len(self.names)):
                rate = Fraction(w.get(s, 0), whole)
                base = done[s] - rate * x
                d = base.denominator * rate.denominator
                self.lines[-1].append((int(base * d), int(rate * d), d))
            span = min((self.totals[s] - done[s]) * whole / w[s] for s in w)
            for s in w:
                done[s] += span * w[s] / whole
            x += span
            left = {s for s in left if done[s] < self.totals[s]}
        self.kept: dict[int, list[int]] = {}

    def taken(self, s: int, j: int) -> int:
        """Tokens of source s in windows 0 to j - 1."""
        if j >= self.windows:
            return self.totals[s]
        x = j * self.window
        a, b, d = self.lines[bisect.bisect_right(self.starts, x) - 1][s]
        return (a + b * x) // d

    def row(self, j: int) -> list[int]:
        if j not in self.kept:
            if len(self.kept) > 20_000:
                self.kept.clear()
            self.kept[j] = [self.taken(s, j) for s in range(len(self.names))]
        return self.kept[j]

    def window_of(self, s: int, g: int) -> int:
        """The window that takes token g of source s."""
        low, high = 0, self.windows - 1
        while low < high:
            mid = (low + high) // 2
            if self.taken(s, mid + 1) > g:
                high = mid
            else:
                low = mid + 1
        return low

    def pieces(self, source: str, g: int, n: int, sequence: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence_id, offset) of tokens g to g + n of the source's queue."""
        s, start = self.index[source], 0
        j = self.window_of(s, g) if n else 0
        while start < n:
            low, high = self.row(j), self.row(j + 1)
            place = sum(low) + sum(high[:s]) - sum(low[:s]) + g + start - low[s]
            length = min(n - start, high[s] - g - start)
            while length > 0:
                fits = min(length, sequence - place % sequence)
                yield start, fits, place // sequence, place % sequence
                start, place, length = start + fits, place + fits, length - fits
            j += 1


_IDS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])


def _tokenized(path: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, press = encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            texts, ids, sources = batch["text"].to_pylist(), batch["doc_id"].to_pylist(), batch["source"].to_pylist()
            for a, b in slices(texts, 2_000_000):
                tokens = [x + end for x in enc.encode(texts[a:b])]
                packed = [press.compress(np.ascontiguousarray(np.frombuffer(t, np.uint8).reshape(-1, 4).T).tobytes()) for t in tokens]
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b], "source": sources[a:b], "n": [len(t) // 4 for t in tokens], "ids": packed}, schema=_IDS)

    return tokenize


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    names = ["start", "length", "sequence_id", "offset"]
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in _PIECES}
        for r in batch.to_pylist():
            planes = np.frombuffer(press.decompress(r["ids"]), np.uint8).reshape(4, -1)
            raw = memoryview(np.ascontiguousarray(planes.T).tobytes())
            for p in r["pieces"]:
                for k in names:
                    rows[k].append(p[k])
                rows["ids_crc32"].append(zlib.crc32(raw[4 * p["start"] : 4 * (p["start"] + p["length"])]))
            for k, v in (("doc_id", r["doc_id"]), ("doc_tokens", r["n"]), ("source", r["source"])):
                rows[k] += [v] * len(r["pieces"])
        yield pa.RecordBatch.from_pydict(rows, schema=_PIECES)


def pack(docs: DataFrame, weights: Mapping[str, int] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    `weights` give target token proportions by source, by default those of the corpus, so that every window repeats its
    mixture. Each document is its ids and the end id; null text is empty, so every row has a piece. A null source is the source named
    by the empty string; rows that repeat a doc_id are packed one by one; an empty table gives an empty result. Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    bare = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    tokenized = cut(bare.mapInArrow(_tokenized(path), "doc_id long, source string, n long, ids binary").withColumn("row", F.monotonically_increasing_id()), "tokens")
    totals = {r["source"]: r["n"] for r in tokenized.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = MixPlan(totals, weights, sequence * window)
    queued = running_sum(tokenized.select("doc_id", "source", "n", "row"), ["source"], ["doc_id", "row"], "n", "_g")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "sequence_id", "offset")]))
        for batch in batches:
            got = [
                [dict(zip(("start", "length", "sequence_id", "offset"), p, strict=True)) for p in plan.pieces(r["source"], r["_g"], r["n"], sequence)]
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(got, kind)], names=["row", "pieces"])

    placed = queued.mapInArrow(place, "row long, pieces array<struct<start long, length long, sequence_id long, offset long>>")
    both = tokenized.join(placed.hint("merge"), "row")
    return both.mapInArrow(_cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), WEIGHTS)


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}

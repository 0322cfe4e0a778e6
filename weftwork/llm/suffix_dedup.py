"""Removal of repeated 50-byte strings by a distributed difference-cover suffix sort.

The difference cover is {1, 2} modulo 3. Suffixes at sampled positions (those with remainder 1 or 2) are named by sorting: triples of bytes,
then triples of triples (9 bytes), then triples of those names (27 bytes), as the recursion on names does, down
to the depth that 50 bytes need. A suffix of any remainder and any other one then have a pair of sampled positions at the same small
distances, so their first 50 bytes are ordered by two names and two bytes. The remaining suffixes
(remainder 0) are merged in that way with each sampled class, and the sampled classes with each other; in the merged order equal prefixes
are adjacent, and the smallest document of each run is kept.

Three exact reductions come first, as sorting every suffix of a corpus is out of reach. (1) Equal 50-byte
strings have equal minimizers, so a string whose least hashed 28-gram occurs in one document only
cannot repeat. (2) What remains is cut at places that its content decides into phrases with an overhang of 49
bytes; equal phrases are sorted once, for the smallest document that holds them. (3) Names are asked for
once for each distinct key of a block, so no long repeat makes a hot key.

Tasks hold blocks as packed arrays; Spark deals out, groups and joins the blocks.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import read_table, skew_join
from weftwork.llm.words import U64, mix
from weftwork.operators.rounds import cut, delete, drop_scratch, scratch_path, shuffles_end

SPAN = 50
GRAM = 28
#: Bytes of texts in a chunk of documents, and of phrases in a block, about.
CHUNK, BLOCK = 8 << 20, 1 << 20
#: Bytes of files whose codes are compared at once, and of phrases whose keys are sorted at once, about.
CODED, RANGE = 6 << 20, 6 << 20
#: Windows of a phrase at most.
LONGEST = 2048
#: Odd numbers and their inverses modulo 2**64.
_BASES = tuple((b, pow(b, -1, 2**64)) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))


# --- packed arrays ---------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed byte planes of a 64-bit array, of its steps if it ascends; high planes that are all zero are left out. The first byte tells how many follow."""
    a = np.ascontiguousarray(a, np.int64)
    if ascending:
        a = np.diff(a, prepend=0)
    n = 8 if a.min(initial=0) < 0 else max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + _zstd()[0].compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes())


def _unpack(b: bytes, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(b[1:]), np.uint8).reshape(b[0], -1)
    a = np.zeros((planes.shape[1], 8), np.uint8)
    a[:, : b[0]] = planes.T
    a = a.reshape(-1).view(np.int64)
    return np.cumsum(a) if ascending else a


class _Bucketed:
    """A scratch table whose buckets by `column` groupings and joins use as they lie."""

    def __init__(self, df: DataFrame, column: str, n: int):
        self.spark, self.name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
        self.path = scratch_path(self.spark, self.name)
        with shuffles_end(self.spark):
            df.write.bucketBy(n, column).sortBy(column).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def size(self) -> int:
        """Bytes of its files."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, self.path)


# --- minimizers of a chunk -------------------------------------------------------------------------


def _eights(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number."""
    return np.ndarray((max(len(x) - 7, 0),), "<u8", x, strides=(1,)).astype(U64)


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-grams: of 8 bytes, of two such, and of two overlapping ones of 16."""
    h = _eights(x)
    for distance, factor in ((8, 0xBF58476D1CE4E5B9), (GRAM - 16, 0xD6E8FEB86659FD93)):
        h *= U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
        right = h[distance:]
        h = h[:-distance] * U64(factor)
        h += right
    h ^= h >> U64(31)
    h *= U64(0x94D049BB133111EB)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    m = h
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size : width - size + len(h) - width + 1])


class _Slice:
    """Some documents of a chunk end to end: bytes, bounds and, as runs of windows with one minimizer, codes."""

    def __init__(self, raws: list[bytes], parts: int):
        self.x = np.frombuffer(b"".join(raws), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        n = len(self.x) - SPAN + 1
        if n <= 0:
            self.start = self.end = self.owner = np.zeros(0, np.int64)
            self.code = np.zeros(0, np.int64)
            return
        least = _least(_gram_hashes(self.x), SPAN - GRAM + 1)
        # a document's windows end 49 bytes before it does
        new = np.append(True, least[1:] != least[:-1])
        edges = np.concatenate([self.bounds, np.maximum(self.bounds[1:] - SPAN + 1, self.bounds[:-1])])
        new[edges[edges < n]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        owner = np.repeat(np.arange(len(raws)), np.diff(np.searchsorted(start, self.bounds)))
        on = start + SPAN <= self.bounds[owner + 1]
        self.start, self.end, self.owner = start[on], end[on], owner[on]
        h = mix(least[self.start])
        # part by the high bits, key by the low 40; what else falls on one code is only looked at in vain
        self.code = (((h >> U64(40)) * U64(parts) >> U64(24)) << U64(40) | (h & U64(2**40 - 1))).astype(np.int64)


def _sliced(table: pa.Table, parts: int, size: int = 1 << 16):
    """(first row, _Slice) over the texts of a chunk in row order, small enough for a core's cache."""
    raws, total, first = [], 0, 0
    texts = table["text"].cast(pa.binary())
    for i, raw in enumerate(texts.to_pylist()):
        if raws and total + len(raw) > size:
            yield first, _Slice(raws, parts)
            raws, total, first = [], 0, i
        raws.append(raw)
        total += len(raw)
    if raws:
        yield first, _Slice(raws, parts)


def _codes(slices: list, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct minimizer codes of a chunk in ascending order, which of them several of its documents hold, and the rank among them of each run's code."""
    code = np.concatenate([s.code for _, s in slices]) if slices else np.zeros(0, np.int64)
    if not len(code):
        return code, np.zeros(0, bool), code
    doc = np.concatenate([doc_ids[first + s.owner] for first, s in slices])
    order = np.argsort(code)
    code, doc = code[order], doc[order]
    new = np.append(True, code[1:] != code[:-1])
    at = np.flatnonzero(new)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return code[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at), rank


_ASK = pa.schema([("part", pa.int32()), ("sender", pa.int64()), ("keys", pa.binary())])


def _ask_codes(parts: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        slices = list(_sliced(table, parts))
        codes, _, _ = _codes(slices, table["doc_id"].to_numpy())
        edges = np.searchsorted(codes, np.arange(parts + 1) << 40)
        rows = [(j, np.ascontiguousarray((codes[a:b] & (2**40 - 1)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()) for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pa.table({"part": [r[0] for r in rows], "sender": [key[0].as_py()] * len(rows), "keys": [r[1] for r in rows]}, schema=_ASK)

    return ask


def _answer_codes(key: tuple, table: pa.Table) -> pa.Table:
    """Which of each sender's keys other senders have too, as bits."""
    asked = []
    for raw in table["keys"].to_pylist():
        a = np.zeros((len(raw) // 5, 8), np.uint8)
        a[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        asked.append(a.reshape(-1).view(np.int64))
    every = np.sort(np.concatenate(asked))
    shared = np.append(np.unique(every[1:][every[1:] == every[:-1]]), 1 << 40)
    bits = [np.packbits(shared[np.searchsorted(shared, a)] == a).tobytes() for a in asked]
    return pa.table({"chunk": table["sender"].to_pylist(), "part": [key[0].as_py()] * len(bits), "bits": bits}, schema=_BITS)


_BITS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())])
_PHRASES = pa.schema([("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("raw", pa.binary())])


def _binary(x: np.ndarray, start: np.ndarray, end: np.ndarray, given: np.ndarray) -> pa.Array:
    """x[start:end] for each row that is given, null for the others."""
    size = np.where(given, end - start, 0)
    ends = np.cumsum(size)
    data = x[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
    bits = np.packbits(given, bitorder="little")
    return pa.Array.from_buffers(pa.large_binary(), len(start), [pa.py_buffer(bits), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _cut_up(s: _Slice, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the runs `on` of a slice as phrases: their bytes with overhang end to end, y, the 8-grams of y, each phrase's start and end in y and its start in the slice.

    Phrases end where adjoining runs end, where 8-grams hash to a rare value, and at LONGEST windows where none does.
    """
    hs, he, owner = s.start[on], s.end[on], s.owner[on]
    new = np.append(True, (he[:-1] != hs[1:]) | (owner[1:] != owner[:-1]))
    place, size = hs[new], he[np.append(new[1:], True)] - hs[new]
    stride = size + SPAN - 1
    begin = np.cumsum(stride) - stride
    stop = begin + size
    y = s.x[np.arange(stride.sum()) + np.repeat(place - begin, stride)]
    eights = _eights(y)
    at = np.flatnonzero(mix(eights) & U64(127) == 0)
    at = at[at < stop[np.searchsorted(begin, at, side="right") - 1]]
    at = at[np.diff(at, prepend=-99) >= 16]  # dense cuts, as of periodic text, are left out
    starts = np.union1d(begin, at)
    run = np.searchsorted(begin, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(y)), stop[run])
    parts = -(-(ends - starts) // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, ends, run = np.repeat(starts, parts) + nth * LONGEST, np.repeat(ends, parts), np.repeat(run, parts)
    return y, eights, starts, np.minimum(ends, starts + LONGEST), starts + (place - begin)[run]


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _keys(eights: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the bytes from start to end, from sums of hashed 8-grams."""
    n, out = max(1 << 16, 1 << len(eights).bit_length()), []
    for base, inverse in _BASES:
        sums = np.append(U64(0), np.cumsum(mix(eights ^ U64(base)) * _powers(base, n)[: len(eights)]))
        out.append(mix((sums[end - 7] - sums[start]) * _powers(inverse, n)[start] + (end - start).astype(U64)).view(np.int64))
    return out


def _phrases(parts: int):
    """Windows that may repeat, as phrases. `raw`, the bytes with overhang, is given once a phrase and chunk, with its smallest document."""

    def phrases(chunk: pa.Table, bits: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _PHRASES.empty_table()
        slices, doc_ids, row_ids = list(_sliced(chunk, parts)), chunk["doc_id"].to_numpy(), chunk["row"].to_numpy()
        codes, hot, rank = _codes(slices, doc_ids)
        edges = np.searchsorted(codes, np.arange(parts + 1) << 40)
        for j, raw in zip(bits["part"].to_pylist(), bits["bits"].to_pylist(), strict=True):
            a, b = edges[j], edges[j + 1]
            hot[a:b] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
        found, ys, at, seen = [], [], 0, 0
        for first, s in slices:
            on = np.flatnonzero(hot[rank[seen : seen + len(s.code)]])
            seen += len(s.code)
            if len(on):
                y, eights, a, b, start = _cut_up(s, on)
                nth = np.searchsorted(s.bounds, start, side="right") - 1
                start -= s.bounds[nth]
                found.append([at + a, start, start + b - a, first + nth, *_keys(eights, a, b + SPAN - 1)])
                ys.append(y)
                at += len(y)
        if not found:
            return _PHRASES.empty_table()
        place, start, end, nth, k1, k2 = (np.concatenate(c) for c in zip(*found, strict=True))
        doc = doc_ids[nth]
        order = np.lexsort((doc, k2, k1))
        leads = np.zeros(len(order), bool)
        leads[order[np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))]] = True
        raw = _binary(np.concatenate(ys), place, place + end - start + SPAN - 1, leads)
        return pa.table([pa.array(np.full(len(k1), chunk["chunk"][0].as_py())), row_ids[nth], doc, start, end, k1, k2, raw], schema=_PHRASES)

    return phrases


# --- names by sorting ------------------------------------------------------------------------------


class _Block:
    """Distinct phrases end to end. kind: remainder of a byte's offset in its phrase; left: bytes from it to the phrase's end."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table["k2"].to_numpy(), table["k1"].to_numpy()))
        self.table = table.take(pa.array(order))
        raws = self.table["raw"].combine_chunks().cast(pa.large_binary())
        size = pc.binary_length(raws).to_numpy()
        ends = np.cumsum(size)
        self.start = ends - size
        _, bounds, data = raws.buffers()
        first = np.frombuffer(bounds, np.int64)[raws.offset]
        self.x = np.append(np.frombuffer(data, np.uint8)[first : first + ends[-1]], np.zeros(64, np.uint8))
        self.phrase = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.left = np.repeat(ends.astype(np.int32), size) - np.arange(ends[-1], dtype=np.int32)
        self.kind = np.frombuffer(bytes(range(3)) * (int(ends[-1]) // 3 + 1), np.uint8)[: ends[-1]] + np.repeat((-self.start % 3).astype(np.uint8), size)
        self.kind -= np.uint8(3) * (self.kind > 2)
        self.doc = self.table["doc_id"].to_numpy()

    def sampled(self, depth: int) -> np.ndarray:
        return np.flatnonzero((self.kind != 0) & (self.left >= depth))


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts key, where in that order a new value begins, and the rank of each value among the distinct ones."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, new, rank


def _distinct(columns: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _dense, of rows of columns of whole numbers from 0. Columns are put into one key of 63 bits, as ranks where they are too wide."""
    columns = iter(columns)
    key = next(columns)
    for c in columns:
        bits = int(c.max(initial=0)).bit_length()
        if int(key.max(initial=0)).bit_length() + bits > 63:
            key = _dense(key)[2]
        if int(key.max(initial=0)).bit_length() + bits > 63:
            c = _dense(c)[2]
            bits = int(c.max(initial=0)).bit_length()
        key = key << bits | c
    return _dense(key)


class _Sorted:
    """The distinct keys of some positions of a block in ascending order. first: a position's index for each distinct key; rank: of each position."""

    def __init__(self, at: np.ndarray, columns: list[np.ndarray]):
        self.at = at
        order, new, self.rank = _distinct(columns)
        self.first = order[new]

    def spread(self, size: int) -> tuple[np.ndarray, int]:
        """The rank at each position of the block, and its width in bits."""
        out = np.zeros(size, np.int64)
        out[self.at] = self.rank
        return out, max(1, len(self.first).bit_length())


def _by_three(at: np.ndarray, of: np.ndarray, width: int, step: int) -> _Sorted:
    """Positions by three values of `of`, each `width` bits wide, `step` apart."""
    if 3 * width > 63:
        return _Sorted(at, [of[at], of[at + step], of[at + 2 * step]])
    n = len(of) - 2 * step
    return _Sorted(at, [(of[:n] << 2 * width | of[step : n + step] << width | of[2 * step :])[at]])


def _nine(b: _Block) -> _Sorted:
    """Sampled positions by their next 9 bytes, three triples."""
    here = np.flatnonzero(np.bincount(b.x, minlength=256))
    code = np.zeros(256, np.int64)
    code[here] = np.arange(len(here))
    x, width = code[b.x], max(1, len(here).bit_length())
    return _by_three(b.sampled(9), x[:-2] << 2 * width | x[1:-1] << width | x[2:], 3 * width, 3)


def _nine_bytes(b: _Block, s: _Sorted) -> list[np.ndarray]:
    x, at = b.x.astype(np.int64), s.at[s.first]
    triples = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    return [triples[at + j] for j in (0, 3, 6)]


def _twenty_seven(b: _Block, nine: _Sorted) -> tuple[_Sorted, list[np.ndarray]]:
    """Sampled positions by three ranks of 9 bytes, and those ranks for each distinct key."""
    r, width = nine.spread(len(b.x))
    s = _by_three(b.sampled(27), r, width, 9)
    at = s.at[s.first]
    return s, [r[at + j] for j in (0, 9, 18)]


#: For each pair of classes: distances of two sampled positions and of two bytes that together cover 50 bytes.
_COVERS = (((0, 1), 1, 22, 0, 49), ((0, 2), 2, 23, 0, 1), ((1, 2), 0, 21, 48, 49))


def _fifty(b: _Block, twenty_seven: _Sorted, shared: np.ndarray) -> tuple[_Sorted, list[np.ndarray]]:
    """Windows, each in the two merges that its class takes part in, by their 50 bytes: two ranks of 27 bytes, both `shared`, and two bytes; and these columns for
    each distinct key, the last with the number of the merge."""
    r, _ = twenty_seven.spread(len(b.x))
    keeps = np.zeros(len(b.x), bool)
    keeps[twenty_seven.at] = shared[twenty_seven.rank]
    x, at, columns, n = b.x.astype(np.int64), [], [], len(b.left)
    for kind, (classes, d1, d2, y1, y2) in enumerate(_COVERS):
        p = np.flatnonzero(keeps[d1 : d1 + n] & keeps[d2 : d2 + n] & (b.left >= SPAN) & (b.kind != 3 - sum(classes)))
        at.append(p)
        columns.append([r[p + d1], r[p + d2], kind << 16 | x[p + y1] << 8 | x[p + y2]])
    c = [np.concatenate(v) for v in zip(*columns, strict=True)]
    s = _Sorted(np.concatenate(at), c)
    return s, [v[s.first] for v in c]


_KEYS = pa.schema([("part", pa.int32()), ("sender", pa.int64()), ("c1", pa.binary()), ("c2", pa.binary()), ("c3", pa.binary()), ("docs", pa.binary())])
_NAMES = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("names", pa.binary())])


def _splits(some: list[bytes], ranges: int) -> list[bytes]:
    """Strings of SPAN bytes at most, ascending, between which about equal numbers of the suffixes of some texts stand."""
    every = np.sort(np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(x, np.uint8), SPAN) for x in some]).view(f"S{SPAN}").ravel()) if some else np.zeros(1, f"S{SPAN}")
    return np.unique(every[(np.arange(1, ranges) * len(every)) // ranges]).tolist()


def _asked(block: int, columns: list[np.ndarray], x: bytes, at: np.ndarray, splits: list[bytes], width: int, docs: np.ndarray | None) -> pa.Table:
    """Messages of ascending keys to the ranges that splits of `width` bytes bound. at: where in x each key's bytes stand, in whose order the keys are.

    Ranges are told by the bytes of whole keys, so frequent beginnings are split like others.
    """
    edges, rows = [0], []
    for split in splits:
        edges.append(bisect_left(at, split, edges[-1], key=lambda i: x[i : i + width]))
    edges.append(len(at))
    for j, (a, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if e > a:
            rows.append({"part": j, "sender": block, "c1": _pack(columns[0][a:e], True), "c2": _pack(columns[1][a:e]), "c3": _pack(columns[2][a:e]), "docs": None if docs is None else _pack(docs[a:e])})
    return pa.Table.from_pylist(rows, schema=_KEYS)


def _gathered(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of the messages to a range end to end, and where each message but the first begins."""
    parts = [_unpack(b.as_py(), column == "c1") for b in table[column]]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1]


def _ranked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_distinct of the keys sent to a range, unpacked column by column, and where each message but the first begins."""
    first, ends = _gathered(table, "c1")
    return *_distinct(chain([first], (_gathered(table, c)[0] for c in ("c2", "c3")))), ends


def _answer_names(key: tuple, table: pa.Table) -> pa.Table:
    """Ranks of keys in the merged order of one range; the range's number makes them ranks over all ranges. Where senders say
    which of their keys several of their documents hold, keys that one document alone holds get 0: they need no further sorting."""
    _, _, rank, ends = _ranked(table)
    alone = None
    if table["docs"][0].is_valid:
        count = np.bincount(rank)
        count += np.bincount(rank[_gathered(table, "docs")[0] > 0], minlength=len(count))
        alone = (count < 2)[rank]
    rank += (key[0].as_py() << 40) + 1
    if alone is not None:
        rank[alone] = 0
    return pa.table({"block": table["sender"].to_pylist(), "part": [key[0].as_py()] * table.num_rows, "names": [_pack(n, True) for n in np.split(rank, ends)]}, schema=_NAMES)


def _answer_docs(key: tuple, table: pa.Table) -> pa.Table:
    """Which of each sender's keys stand in a run of adjacent equal prefixes with a smaller document than the sender's, as bits."""
    order, new, rank, ends = _ranked(table)
    docs, _ = _gathered(table, "docs")
    smaller = np.minimum.reduceat(docs[order], np.flatnonzero(new))[rank] < docs
    answers = np.split(smaller, ends)
    return pa.table({"block": table["sender"].to_pylist(), "part": [key[0].as_py()] * len(answers), "names": [np.packbits(x).tobytes() for x in answers], "n": [len(x) for x in answers]}, schema=_NAMES.append(pa.field("n", pa.int64())))


def _returned(names: pa.Table) -> np.ndarray:
    rows = sorted(names.to_pylist(), key=lambda r: r["part"])
    return np.concatenate([_unpack(r["names"], True) for r in rows]) if rows else np.zeros(0, np.int64)


_MASKS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("mask", pa.binary())])


def _repeated_windows(blocks: DataFrame, ranges: int) -> DataFrame:
    """(k1, k2, mask): for each distinct phrase of blocks(block, k1, k2, doc_id, raw) with such windows, as bits, those that a smaller document than its own holds too."""
    # at most so many ranges of keys, from the beginnings of about 2000 phrases; they only decide how evenly the work is dealt
    share = min(1.0, 2000 / max(blocks.count(), 1))
    some = blocks.filter(F.pmod(F.xxhash64("k1"), F.lit(1 << 40)) < int(share * (1 << 40))).select(F.substring("raw", 1, 256).alias("raw")).limit(4000).collect()
    splits = _splits([bytes(r["raw"]) for r in some], ranges)
    splits9, splits27, splits48 = (sorted({x[:n] for x in splits}) for n in (9, 27, 48))
    ask_type, name_type = "part int, sender long, c1 binary, c2 binary, c3 binary, docs binary", "block long, part int, names binary"

    def ask9(key: tuple, table: pa.Table) -> pa.Table:
        b = _Block(table)
        s = _nine(b)
        return _asked(key[0].as_py(), _nine_bytes(b, s), b.x.tobytes(), s.at[s.first], splits9, 9, None)

    def ask27(table: pa.Table, names: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _KEYS.empty_table()
        b = _Block(table)
        s, ranks = _twenty_seven(b, _nine(b))
        n9, doc = _returned(names), b.doc[b.phrase[s.at]]
        several = np.zeros(len(s.first), np.int64)
        several[s.rank[doc != doc[s.first][s.rank]]] = 1
        return _asked(table["block"][0].as_py(), [n9[r] for r in ranks], b.x.tobytes(), s.at[s.first], splits27, 27, several)

    def fifty_of(table: pa.Table, n27: np.ndarray) -> tuple[_Block, _Sorted, list[np.ndarray], np.ndarray]:
        """Windows whose names several documents hold; with the smallest document of this block for each distinct key."""
        b = _Block(table)
        s, columns = _fifty(b, _twenty_seven(b, _nine(b))[0], n27 > 0)
        docs = np.full(len(s.first), np.iinfo(np.int64).max)
        np.minimum.at(docs, s.rank, b.doc[b.phrase[s.at]])
        return b, s, columns, docs

    def ask50(table: pa.Table, names: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _KEYS.empty_table()
        n27 = _returned(names)
        b, s, (r1, r2, rest), docs = fifty_of(table, n27)
        # two names stand for the 48 bytes from the first one's place on
        at = s.at[s.first] + np.array([c[1] for c in _COVERS])[rest >> 16]
        return _asked(table["block"][0].as_py(), [n27[r1], n27[r2], rest], b.x.tobytes(), at, splits48, 48, docs)

    def masks(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _MASKS.empty_table()
        told = pc.is_valid(answers["n"])
        bits = answers.filter(told)
        b, s, _, docs = fifty_of(table, _returned(answers.filter(pc.invert(told)).drop_columns(["n"])))
        smaller = np.zeros(len(docs), bool)
        at = 0
        rows = sorted(bits.to_pylist(), key=lambda r: r["part"])
        for r in rows:
            smaller[at : at + r["n"]] = np.unpackbits(np.frombuffer(r["names"], np.uint8), count=r["n"]).astype(bool)
            at += r["n"]
        repeated = np.zeros(len(b.phrase), bool)
        repeated[s.at[smaller[s.rank] | (docs[s.rank] < b.doc[b.phrase[s.at]])]] = True
        found = np.unique(b.phrase[repeated])
        ends = np.append(b.start[1:], len(b.phrase)) - SPAN + 1
        bits = [np.packbits(repeated[i:j]).tobytes() for i, j in zip(b.start[found].tolist(), ends[found].tolist(), strict=True)]
        return pa.table([*b.table.select(["k1", "k2"]).take(pa.array(found)).columns, pa.array(bits, pa.binary())], schema=_MASKS)

    of = blocks.groupBy("block")
    n9 = cut(of.applyInArrow(ask9, ask_type).groupBy("part").applyInArrow(_answer_names, name_type), "names9")
    n27 = cut(of.cogroup(n9.groupBy("block")).applyInArrow(ask27, ask_type).groupBy("part").applyInArrow(_answer_names, name_type), "names27")
    drop_scratch(n9)
    bits = cut(of.cogroup(n27.groupBy("block")).applyInArrow(ask50, ask_type).groupBy("part").applyInArrow(_answer_docs, f"{name_type}, n long"), "smaller")
    answers = n27.withColumn("n", F.lit(None).cast("long")).unionByName(bits)
    out = cut(of.cogroup(answers.groupBy("block")).applyInArrow(masks, "k1 long, k2 long, mask binary"), "masks")
    drop_scratch(n27, bits)
    return out


# --- the whole -------------------------------------------------------------------------------------

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _before(c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of c are true before each of the bounds."""
    out = np.zeros(len(c) + 1, np.int32)
    np.cumsum(c, dtype=np.int32, out=out[1:])
    return out[bounds].astype(np.int64)


def _remove(chunk: pa.Table, ranges: pa.Table) -> pa.Table:
    """Each document without the bytes of its removed windows: all of s to e, or those that mask tells."""
    if not chunk.num_rows:
        return _OUT.empty_table()
    chunk = chunk.sort_by("row")
    texts, rows = chunk["text"].cast(pa.binary()).combine_chunks(), chunk["row"].to_numpy()
    bounds = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))).astype(np.int64)
    x = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    base = bounds[np.searchsorted(rows, ranges["row"].to_numpy())]
    start, end, masked = base + ranges["s"].to_numpy(), base + ranges["e"].to_numpy(), pc.is_valid(ranges["mask"]).to_numpy()
    # at most 50 windows cover a byte, each in one range
    step = np.zeros(len(x) + 1, np.int8)
    np.add.at(step, start[~masked], 1)
    np.add.at(step, end[~masked] + SPAN - 1, -1)
    for i in np.flatnonzero(masked):
        at = start[i] + np.flatnonzero(np.unpackbits(np.frombuffer(ranges["mask"][int(i)].as_py(), np.uint8), count=int(end[i] - start[i])))
        step[at] += 1
        step[at + SPAN] -= 1
    gone = np.cumsum(step[:-1], dtype=np.int8) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    heads = bounds[:-1][bounds[:-1] < len(x)]
    opens[heads] = gone[heads]
    lost, spans = (_before(c, bounds) for c in (gone, opens))
    kept = bounds - lost
    data = pa.py_buffer(np.ascontiguousarray(x[~gone]))
    left = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(kept.astype(np.int64)), data]).cast(pa.binary())
    return pa.table([chunk["doc_id"], np.diff(bounds), np.diff(lost), np.diff(spans), left], schema=_OUT)


def _chunked(docs: DataFrame) -> DataFrame:
    """docs with `row`, a number of its own, and `chunk`: the texts of a task, which one large row group of a file may fill, are dealt over chunks by their bytes."""
    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("row", 33))
    sizes = rows.groupBy("_task").agg(F.ceil(F.sum(F.octet_length("text")) / CHUNK).alias("_n"))
    nth = F.pmod(F.xxhash64("doc_id"), F.greatest("_n", F.lit(1)))
    return rows.join(F.broadcast(sizes), "_task", "left").select(*docs.columns, "row", (F.shiftleft("_task", 20) + nth).alias("chunk"))


def remove_repeats(docs: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of every row of docs.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id; null text
    is empty; rows that repeat a doc_id are one document in this respect and each keeps its row; rows without
    doc_id stay as they are and count for no other. An empty table gives an empty result. Other columns are not read.
    The result, or what `finish` makes of it, is a scratch table; all that led to it is deleted.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = _Bucketed(_chunked(bare.filter(F.col("doc_id").isNotNull())), "chunk", parts)
    of = chunks.rows.groupBy("chunk")
    # parts of codes, blocks and ranges are as many as the input asks for, so what is held at once does not grow with it
    coded = max(parts, -(-chunks.size() // CODED))
    bits = of.applyInArrow(_ask_codes(coded), "part int, sender long, keys binary").groupBy("part").applyInArrow(_answer_codes, "chunk long, part int, bits binary")
    whole = cut(of.cogroup(bits.groupBy("chunk")).applyInArrow(_phrases(coded), "chunk long, row long, doc_id long, s long, e long, k1 long, k2 long, raw binary"), "phrases")
    size = whole.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    owners = whole.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", F.col("raw").isNull().alias("none"), "raw")).alias("_own"), F.count("*").alias("n"))
    distinct = owners.select("k1", "k2", F.col("_own.doc_id").alias("doc_id"), F.col("_own.raw").alias("raw"), "n")
    blocked = distinct.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.lit(max(parts, -(-size // BLOCK)))).cast("long"))
    # dealt like the buckets, each task writes one file, not one for each bucket
    blocks = _Bucketed(blocked.repartition(parts, "block"), "block", parts)
    phrases = cut(whole.drop("raw"), "phrases")
    drop_scratch(whole)
    masks = _repeated_windows(blocks.rows.drop("n"), max(parts, -(-size // RANGE)))
    known = cut(blocks.rows.select("k1", "k2", F.col("doc_id").alias("owner"), "n").join(masks, ["k1", "k2"], "left").filter("n > 1 OR mask IS NOT NULL"), "known")
    blocks.drop()
    met = skew_join(phrases, known, ["k1", "k2"], "n")
    # a copy of a phrase lies in the same run as its owner's, so a smaller document than the copy's is in the run of each of its windows
    ranges = met.filter("doc_id > owner OR mask IS NOT NULL").select("chunk", "row", "s", "e", F.when(F.col("doc_id") == F.col("owner"), F.col("mask")).alias("mask"))
    removed = of.cogroup(ranges.groupBy("chunk")).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    rest = bare.filter(F.col("doc_id").isNull()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    out = cut(finish(removed.unionByName(rest)), "repeats_removed")
    chunks.drop()
    drop_scratch(phrases, masks, known)
    return out


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

    return remove_repeats(read_table(spark, sf_dir, "documents"), digest)


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}

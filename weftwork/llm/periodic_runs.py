"""Periodic runs of words, found by uniting suffix classes in the order of descending LCP.

A run is a stretch of words with smallest period q and a length of at least max(6, 4 q) that no neighbouring word extends
with period q. Suffixes of a text are ordered by prefix doubling; neighbours in that order that agree in five words or more are
edges, and Kruskal's algorithm takes the longest agreements first. A class holds the places whose suffixes agree that far, as an
ordered set. Uniting two classes at agreement l makes some places p < s of different classes neighbours; they agree in
just l words, so with q = s - p the words from p to s + l have period q. They seed a run if l reaches
max(3 q, 6 - q) and the word before p breaks the period: places between p and s would have been there before, had the stretch a
smaller period, so q is the smallest, and each run has one first place, so it is found once.

Words are numbered exactly, by a table of each text's words. Texts are worked on together, a million characters at a time, and no
class crosses a text. A single text is held whole, with about 4 log2(longest repeat) bytes a word.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import read_table
from weftwork.llm.words import slices

LEAST, TIMES = 6, 4
#: Agreement without which no run can begin.
SHORTEST = LEAST - 1


def numbered(texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, place of each text's first word). Equal words of a text share a number; a mark of its own stands
    before the first text and after each."""
    parts, first, low = [np.zeros(1, np.int64)], [1], 1
    for words in texts:
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) + low
        low += len(numbers)
        parts += [own, np.array([low])]
        low += 1
        first.append(first[-1] + len(words) + 1)
    return np.concatenate(parts), np.array(first)


def edges(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(agreement, place, place) of neighbours in the order of suffixes that agree in SHORTEST words at least, longest first."""
    n = len(symbols)
    index = np.arange(n)
    count = np.bincount(symbols)
    kind = np.int32 if n < 2**31 else np.int64
    rank = (np.cumsum(count) - count)[symbols].astype(kind)
    tied, near = np.flatnonzero(count[symbols] > 1), np.zeros(0, np.int64)
    levels, k = [(1, rank)], 1
    while len(tied):
        key = rank[tied].astype(np.int64) * n + rank[tied + k]
        order = np.argsort(key, kind="stable")
        key, tied = key[order], tied[order]
        old = key // n
        new = np.append(True, key[1:] != key[:-1])
        at = index[: len(key)]
        start = np.maximum.accumulate(np.where(new, at, 0))
        base = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        rank = rank.copy()
        rank[tied] = old + start - base
        tied, k = tied[~(new & np.append(new[1:], True))], 2 * k
        levels.append((k, rank))
        if k == 4:
            near = tied
    if not len(near):
        return near, near, near
    near = near[np.argsort(rank[near])]
    agree4 = levels[2][1][near]
    same = agree4[1:] == agree4[:-1]
    i, j = near[:-1][same], near[1:][same]
    length = np.zeros(len(i), np.int64)
    for k, level in reversed(levels):
        length += k * (level[i + length] == level[j + length])
    far = np.flatnonzero(length >= SHORTEST)
    far = far[np.argsort(-length[far], kind="stable")]
    return length[far], i[far], j[far]


def runs(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, period) of every run, in the order of place and period."""
    found: list[tuple[int, int, int]] = []
    home: dict[int, list[int]] = {}

    def seed(p: int, s: int, agreement: int) -> None:
        q = s - p
        if (TIMES - 1) * q <= agreement and q + agreement >= LEAST and symbols[p - 1] != symbols[s - 1]:
            found.append((p, q + agreement, q))

    for agreement, i, j in zip(*(x.tolist() for x in edges(symbols)), strict=True):
        large, small = home.get(i) or [i], home.get(j) or [j]
        if len(large) < len(small):
            large, small = small, large
        last = -1
        for m, x in enumerate(small):
            k = bisect_left(large, x, last + 1)
            if k > last + 1:
                seed(large[k - 1], x, agreement)
            if k < len(large) and (m + 1 == len(small) or large[k] < small[m + 1]):
                seed(x, large[k], agreement)
            large.insert(k, x)
            home[x] = large
            last = k
        home[i] = home[j] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary()),
])
Places = Callable[[int | None, int], "np.ndarray | None"]


def _found(places: Places | None):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for a, b in slices(all_texts):
                ids, texts = all_ids[a:b], [t.split() for t in all_texts[a:b]]
                if places:
                    for k, words in enumerate(texts):
                        if (at := places(ids[k], len(words))) is not None:
                            texts[k] = [words[x] for x in at.tolist()]
                symbols, first = numbered(texts)
                own: list[list[tuple[int, int, int]]] = [[] for _ in ids]
                for run in runs(symbols):
                    k = int(np.searchsorted(first, run[0], "right")) - 1
                    own[k].append((run[0] - int(first[k]), run[1], run[2]))
                collapsed = []
                for words, those in zip(texts, own, strict=True):
                    if those:
                        edge = np.zeros(len(words) + 1, np.int64)
                        start, length, period = np.array(those).T
                        np.add.at(edge, start + period, 1)
                        np.add.at(edge, start + length, -1)
                        words = [words[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words))
                told = [[{"start": s, "length": n, "period": q} for s, n, q in those] for those in own]
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": [len(w) for w in texts], "runs": told, "collapsed": collapsed}, schema=_OUT)

    return found


def periodic_runs(docs: DataFrame, places: Places | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed for every row of docs.

    Words are what stands between ASCII white space, told apart by their bytes, numbered from 0. `collapsed` has the words, joined by
    one blank, without those that some run holds after its first `period` words. Null and blank texts have no words, no runs and
    an empty `collapsed`; repeated rows and rows without doc_id are worked on like others; an empty table gives an empty result; other
    columns are not read. places(doc_id, n), if given, may return the numbers of the words to read in place of 0 to n - 1.
    """
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return bare.mapInArrow(_found(places), kind).withColumn("collapsed", F.col("collapsed").cast("string"))


def highest(found: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones; null where there is none."""
    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's texts: in one document of ten, the words from a on repeat the first p of them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs(read_table(spark, sf_dir, "documents"), looped).withColumn("_best", highest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    milli = F.expr("1000 * _best.length div _best.period")
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")), milli.alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict[str, str] = {}

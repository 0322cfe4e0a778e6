"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each five-word shingle is hashed once; the high bits choose one of BINS bins and each bin keeps its least
hash. An empty bin copies the bin that a fixed sequence of random draws (the same for every text) first finds filled. Only the
low BITS bits of each bin are kept, two bins a byte. Unequal values agree in their low bits with chance
1/16, which likeness() takes out of the share of equal bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import cut, read_table
from weftwork.llm.words import U64, Words, mix, shingle_hashes, slices

BINS, BITS = 512, 4
_SHIFT = U64(64 - 9)


def _densify(least: np.ndarray, filled: np.ndarray) -> None:
    """Fills the empty bins of each row in place; every row has a filled bin."""
    rows, bins = np.nonzero(~filled)
    draw = 0
    while len(rows):
        draw += 1
        pick = (mix(bins.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(draw)) >> _SHIFT).astype(np.int64)
        hit = filled[rows, pick]
        least[rows[hit], bins[hit]] = least[rows[hit], pick[hit]]
        rows, bins = rows[~hit], bins[~hit]


def fingerprints(texts: Sequence[str]) -> np.ndarray:
    """uint8 array of len(texts) x BINS/2."""
    out = np.zeros((len(texts), BINS // 2), np.uint8)
    for a, b in slices(texts):
        h, doc = shingle_hashes(Words(texts[a:b]))
        none = U64(2**64 - 1)
        least = np.full((b - a) * BINS, none)
        value = h & U64(2**55 - 1)
        np.minimum.at(least, doc * BINS + (h >> _SHIFT).astype(np.int64), value)
        least = least.reshape(b - a, BINS)
        filled = least != none
        alone = np.flatnonzero(filled.sum(1) == 1)
        least[alone] = least[alone].min(1)[:, None]
        filled[alone] = True
        _densify(least, filled)
        low = (least & U64(2**BITS - 1)).astype(np.uint8)
        out[a:b] = low[:, 0::2] << 4 | low[:, 1::2]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingles, row by row, in 0 to 1."""
    same = ((a >> 4) == (b >> 4)).sum(1) + ((a & 15) == (b & 15)).sum(1)
    chance = 1 / 2**BITS
    return np.clip((same / BINS - chance) / (1 - chance), 0, 1)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_MARKED = pa.schema([*_ROW, ("pid", pa.int32()), ("kind", pa.string()), ("text", pa.string())])


def _columns(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> dict:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    prints = fingerprints(changed)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [x.tobytes() for x in own], "edited_fingerprint": [x.tobytes() for x in prints],
        "near_edited": likeness(own, prints), "near_next": likeness(own, after),
    }


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range of documents in order. The first and the last are also given with their text."""
    held: tuple | None = None

    def made(columns: dict, n: int, pid: int, kind: str, text: list | None = None) -> pa.RecordBatch:
        empty = {f.name: [None] * n for f in _MARKED}
        return pa.RecordBatch.from_pydict(empty | columns | {"pid": [pid] * n, "kind": [kind] * n, "text": text or [None] * n}, schema=_MARKED)

    pid = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        pid = batch["pid"][0].as_py()
        all_ids, all_texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        if held is None:
            yield made({"doc_id": all_ids[:1]}, 1, pid, "head", all_texts[:1])
        for a, b in slices(all_texts, 2_000_000):
            prints = fingerprints(all_texts[a:b])
            ids, texts = all_ids[a:b], all_texts[a:b]
            if held is not None:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.vstack([held[2], prints])
            if len(ids) > 1:
                yield made(_columns(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]), len(ids) - 1, pid, "row")
            held = ids[-1], texts[-1], prints[-1:]
    if held is not None:
        yield made({"doc_id": [held[0]]}, 1, pid, "tail", [held[1]])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, following = batch["text"].to_pylist(), batch["following"].to_pylist()
        yield pa.RecordBatch.from_pydict(_columns(batch["doc_id"].to_pylist(), texts, following, fingerprints(texts), fingerprints(following)), schema=_ROW)


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (lowercase
    hex), near_edited, near_next.

    The next document is the one that follows in descending doc_id, after the last the first. Null text counts as empty; texts
    without words are alike. Rows that repeat a doc_id follow each other by a hash of the text; rows without
    doc_id come last. A single row is its own next. An empty table gives an empty result; other columns are not read.

    Documents are dealt by ranges of doc_id and each range is walked in order; only its first and last
    text are kept, to join the ranges.
    """
    spark = docs.sparkSession
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    order = [F.desc("doc_id"), F.desc("_tie")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bare.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("pid"))
    done = cut(dealt.mapInArrow(_within, f"{_OUT}, pid int, kind string, text string"), "fingerprints")
    # one row a range, however many documents
    pids = sorted(r["pid"] for r in done.filter("kind = 'head'").select("pid").collect())
    ring = spark.createDataFrame(list(zip(pids, [*pids[1:], *pids[:1]], strict=True)), "pid int, next int")
    heads = done.filter("kind = 'head'").select(F.col("pid").alias("next"), F.col("text").alias("following"))
    tails = done.filter("kind = 'tail'").select("pid", "doc_id", "text").join(ring, "pid").join(heads, "next")
    rest = tails.select("doc_id", "text", "following").mapInArrow(_across, _OUT)
    names = [c.split()[0] for c in _OUT.split(", ")]
    both = done.filter("kind = 'row'").select(*names).unionByName(rest)
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLE_SQL: dict[str, str] = {}

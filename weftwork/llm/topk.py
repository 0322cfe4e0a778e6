"""Exact top-k search by inner product over an M-tree of pages.

The upper nodes of the tree are pivots, found on a bounded sample; every vector hangs under its nearest pivot. Below a pivot
are leaf pages of at most PAGE vectors. A page keeps its routing object (one of its vectors), its covering radius, its distance
to the pivot and the distance of each vector to the routing object. Vectors x in a ball of radius r round c
have <q, x> <= <q, c> + |q| r, and |d(q, p) - d(p, c)| <= d(q, c) gives a bound on <q, c> without looking at c.

The search is best-first: each query goes down to the page of its nearest pivot whose routing object has the highest product with it,
which gives it k good scores, and then to all pivots whose bound reaches the worst of them; there pages, and vectors in
pages, that cannot reach it are passed over by the stored distances. All components are whole numbers and scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm.common import cut, read_table

SCALE, PAGE, BLOCK = 256, 256, 512
#: Vectors of each length from which pivots are taken, and pivots at most.
SAMPLE, PIVOTS = 4096, 256
#: Pages over which one part of the search runs.
PART = 4096


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as int32 if all fit, else as float64, which holds every floor(scale * component) exactly."""
    return x.astype("<i4" if not x.size or np.abs(x).max() < 2**31 else "<f8").tobytes()


def _matrix(rows: Sequence[bytes], dim: int) -> np.ndarray:
    raw = b"".join(rows)
    if len(raw) == 4 * dim * len(rows):
        return np.frombuffer(raw, "<i4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(r, "<i4" if len(r) == 4 * dim else "<f8") for r in rows]).astype(np.float64)


def _block(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * dim * n else "<f8").reshape(n, dim).astype(np.float64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _below(bound: np.ndarray, tau: np.ndarray | float, size: np.ndarray | float) -> np.ndarray:
    """Whether bound stays under tau by more than rounding may explain; size sums the squared lengths that went in. Overflow is never below."""
    return bound < tau - 1e-6 * size - 1e-3


def products(q: np.ndarray, x: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, cut to the range of a long; those surely under tau[row] may be inexact."""
    score = q @ x.T
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    wide = ~(nq[:, None] * nx[None, :] < 2.0**106)
    out = np.where(wide, 0, score).astype(np.int64)
    if wide.any():  # beyond 2**53 float64 rounds: these few products are summed as Python integers
        out[wide] = np.iinfo(np.int64).min
        for i, j in np.argwhere(wide & ~_below(score, tau[:, None], nq[:, None] + nx[None, :])):
            exact = sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))
            out[i, j] = min(max(exact, -(2**63)), 2**63 - 1)
    return out


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, q): floor(scale * component) packed, of the vectors that hold neither nulls nor non-finite components.

    Numbers beyond the largest double once scaled count as the largest double."""
    x = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("x")).filter(F.size("x") > 0)
    x = x.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"]
            flat, ends = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy() - x.offsets[0].as_py()
            with np.errstate(over="ignore"):
                q = np.nan_to_num(np.floor(flat * scale))
            rows = [_packed(q[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].cast(pa.int64()), pa.array(np.diff(ends).astype(np.int32)), pa.array(rows, pa.binary())], names=["vec_id", "dim", "q"])

    return x.mapInArrow(packed, "vec_id long, dim int, q binary")


class Pivots:
    """The upper nodes: for each length of vectors a range of node numbers and their vectors; radii once known."""

    def __init__(self, sample: list[tuple[int, bytes]], wanted: dict[int, int]):
        self.by_dim: dict[int, tuple[int, np.ndarray]] = {}
        self.radius: dict[int, float] = {}
        nodes = 0
        for dim in sorted(wanted):
            x = _matrix([q for d, q in sample if d == dim], dim)
            chosen, far = [0], _distance(x, x[:1])[:, 0]
            while len(chosen) < wanted[dim] and far.max() > 0:  # the farthest from those chosen
                chosen.append(int(far.argmax()))
                far = np.minimum(far, _distance(x, x[chosen[-1] : chosen[-1] + 1])[:, 0])
            self.by_dim[dim] = nodes, x[chosen]
            nodes += len(chosen)


def build(whole: DataFrame) -> tuple[Pivots, DataFrame]:
    """The pivots with their covering radii, and the table of leaf pages."""
    counts = {r["dim"]: r["count"] for r in whole.groupBy("dim").count().collect()}
    wanted = {d: max(1, min(PIVOTS if d <= 4096 else 16, n // (8 * PAGE))) for d, n in counts.items()}
    several = [d for d in sorted(counts) if wanted[d] > 1]
    few = whole.filter(~F.col("dim").isin(several)) if several else whole
    sample = [(r["dim"], r["q"]) for r in few.groupBy("dim").agg(F.min_by("q", F.struct("vec_id", "q")).alias("q")).collect()]
    for dim in several:
        sample += [(dim, r["q"]) for r in whole.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE if dim <= 4096 else 16).collect()]
    pivots = Pivots(sample, wanted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            node, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                first, centers = pivots.by_dim[int(dim)]
                d = _distance(_matrix(batch["q"].take(pa.array(at)).to_pylist(), int(dim)), centers)
                node[at], dist[at] = first + d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["dim"], batch["q"], pa.array(node), pa.array(dist)], names=["vec_id", "dim", "q", "node", "dist"])

    placed = cut(whole.mapInArrow(assign, "vec_id long, dim int, q binary, node int, dist double"), "placed")
    pivots.radius = {r["node"]: r["r"] for r in placed.groupBy("node").agg(F.max("dist").alias("r")).collect()}

    def split(x: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """Parts of at most PAGE rows: two far vectors are promoted and each row goes to the nearer, half to either side."""
        if len(at) <= PAGE:
            yield at
            return
        a = _distance(x[at], x[at[:1]])[:, 0].argmax()
        da = _distance(x[at], x[at[a : a + 1]])[:, 0]
        db = _distance(x[at], x[at[da.argmax() :][:1]])[:, 0]
        order = np.argsort(da - db, kind="stable")
        half = len(at) // 2
        yield from split(x, at[order[:half]])
        yield from split(x, at[order[half:]])

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 32
        for batch in batches:
            nodes = batch["node"].to_numpy()
            edges = np.flatnonzero(np.diff(nodes, prepend=-1, append=-1))
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                dim = batch["dim"][int(a)].as_py()
                x, ids, dist = _matrix(batch["q"].slice(a, b - a).to_pylist(), dim), batch["vec_id"].to_numpy()[a:b], batch["dist"].to_numpy()[a:b]
                for part in split(x, np.arange(b - a)):
                    part = part[np.argsort(ids[part], kind="stable")]
                    mean = x[part].mean(0, keepdims=True)
                    c = part[_distance(x[part], mean)[:, 0].argmin()]
                    d = _distance(x[part], x[c : c + 1])[:, 0]
                    rows.append({"node": int(nodes[a]), "page": page, "dim": dim, "center": _packed(x[c]), "radius": float(d.max()), "to_pivot": float(dist[c])})
                    rows[-1] |= {"ids": ids[part].astype("<i8").tobytes(), "vectors": _packed(x[part]), "to_center": d.tobytes()}
                    page += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)

    parts = max(1, math.ceil(sum(counts.values()) / (16 * PAGE)))
    dealt = placed.repartitionByRange(parts, "node", "dist", "vec_id").sortWithinPartitions("node", "dist", "vec_id")
    return pivots, cut(dealt.mapInArrow(paged, "node int, page long, dim int, center binary, radius double, to_pivot double, ids binary, vectors binary, to_center binary"), "pages")


_PAGES = pa.schema([("node", pa.int32()), ("page", pa.int64()), ("dim", pa.int32()), ("center", pa.binary()), ("radius", pa.float64()), ("to_pivot", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("to_center", pa.binary())])
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


_ROUTED = pa.schema([("query_id", pa.int64()), ("node", pa.int32()), ("q", pa.binary()), ("to_pivot", pa.float64()), ("tau", pa.float64())])
_BEST = pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("page", pa.int64()), ("near", pa.float64())])


def _routes(pivots: Pivots, nearest: bool):
    """Query rows (vec_id, dim, q, tau) to (query_id, node, q, to_pivot, tau): to the nearest pivot, or to all that may hold a score of tau."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in _ROUTED.names}
            for r in batch.to_pylist():
                first, centers = pivots.by_dim[r["dim"]]
                q = _matrix([r["q"]], r["dim"])
                d, qq = _distance(q, centers)[0], (q * q).sum()
                radius = np.array([pivots.radius.get(first + k, 0.0) for k in range(len(centers))])
                below = _below(centers @ q[0] + np.sqrt(qq) * radius, r["tau"], qq + (centers * centers).sum(1) + radius**2)
                for k in [int(np.argmin(d))] if nearest else np.flatnonzero(~below).tolist():
                    for c, v in zip(_ROUTED.names, (r["vec_id"], first + k, r["q"], float(d[k]), r["tau"]), strict=True):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_ROUTED)

    return route


def _pack(by: str):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({
            by: key[0:1], "query_ids": [table["query_id"].to_numpy().astype("<i8").tobytes()], "queries": pa.array([table["q"].to_pylist()], pa.list_(pa.binary())),
            "dists": [table["to_pivot"].to_numpy().tobytes()], "taus": [table["tau"].to_numpy().tobytes()],
        })

    return pack


def _nearest_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries beside (dim, pages, centers) of a part of a node to the page of that part that each query likes best."""
    for batch in batches:
        for r in batch.to_pylist():
            q, c = _matrix(r["queries"], r["dim"]), _matrix(r["centers"], r["dim"])
            near = np.nan_to_num(q @ c.T)
            at = near.argmax(1)
            yield pa.RecordBatch.from_pydict({"query_id": np.frombuffer(r["query_ids"], "<i8"), "q": r["queries"], "page": np.array(r["pages"])[at], "near": near.max(1)}, schema=_BEST)


def _search(k: int):
    """Blocks of queries beside a page to their hits in it: at most k a query, none that cannot reach its tau."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch[n][i].as_py() for n in batch.schema.names}
                qids, tau, d_qp = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["taus"]), np.frombuffer(r["dists"])
                q, c = _matrix(r["queries"], r["dim"]), _matrix([r["center"]], r["dim"])
                qq, cc, radius = (q * q).sum(1), (c * c).sum(), r["radius"]
                # by the distances to the pivot alone: <q,c> = (|q|^2 + |c|^2 - d(q,c)^2) / 2 and d(q,c) >= |d(q,p) - d(p,c)|
                quick = (qq + cc - (d_qp - r["to_pivot"]) ** 2) / 2 + np.sqrt(qq) * radius
                on = np.flatnonzero(~_below(quick, tau, qq + cc + d_qp**2 + radius**2))
                on = on[~_below(q[on] @ c[0] + np.sqrt(qq[on]) * radius, tau[on], qq[on] + cc + radius**2)]
                if not len(on):
                    continue
                ids, d_xc = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["to_center"])
                x = _block(r["vectors"], r["dim"], len(ids))
                d_qc, xx = _distance(q[on], c)[:, 0], (x * x).sum(1)
                best = (qq[on].max() + xx - np.maximum(np.maximum(d_qc.min() - d_xc, d_xc - d_qc.max()), 0) ** 2) / 2
                cols = np.flatnonzero(~_below(best, tau[on].min(), qq[on].max() + xx + d_qc.max() ** 2 + d_xc**2))
                score = products(q[on], x[cols], tau[on])
                other = qids[on][:, None] != ids[cols][None, :]
                score[~other] = np.iinfo(np.int64).min
                least = np.full(len(on), np.iinfo(np.int64).min)
                if score.shape[1] > k:
                    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                a, b = np.nonzero((score >= least[:, None]) & (score.astype(float) >= tau[on][:, None]) & other)
                order = np.lexsort((ids[cols][b], ~score[a, b], a))
                a, b = a[order], b[order]
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                a, b = a[nth < k], b[nth < k]
                yield pa.RecordBatch.from_pydict({"query_id": qids[on][a], "vec_id": ids[cols][b], "score": score[a, b]}, schema=_HITS)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of every query row among the other rows.

    Ties go to the smaller vec_id; a query with fewer others gets them all. Vectors that are null or hold null or
    non-finite components, rows without vec_id and vectors without components take no part; only vectors
    of a query's length are compared with it, and rows that repeat its vec_id are its own. Scores beyond the range of a long count as its end. An empty table gives an empty result. Other columns are not read.
    """
    whole = cut(whole_vectors(vectors), "vectors")
    pivots, pages = build(whole)
    queries = whole.filter(is_query)
    blocks, parts = max(1, math.ceil(queries.count() / BLOCK)), max(1, math.ceil(pages.count() / PART))
    part = F.pmod(F.col("page"), F.lit(parts)).cast("int").alias("part")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def route(rows: DataFrame, nearest: bool) -> DataFrame:
        routed = rows.mapInArrow(_routes(pivots, nearest), "query_id long, node int, q binary, to_pivot double, tau double")
        return packed(routed, "node", "int").select("*", everywhere)  # a node's pages lie in `parts` parts, so no task meets a whole node

    def packed(rows: DataFrame, by: str, kind: str) -> DataFrame:
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
        return rows.groupBy(by, block).applyInArrow(_pack(by), f"{by} {kind}, query_ids binary, queries array<binary>, dists binary, taus binary")

    def highest(rows: DataFrame) -> DataFrame:
        hits = rows.mapInArrow(_search(k), "query_id long, vec_id long, score long")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    anything = F.lit(float("-inf"))
    centers = pages.groupBy("node", part).agg(F.first("dim").alias("dim"), F.collect_list(F.struct("page", "center")).alias("c"))
    centers = centers.select("node", "part", "dim", F.col("c.page").alias("pages"), F.col("c.center").alias("centers"))
    liked = centers.join(route(queries.withColumn("tau", anything), True), ["node", "part"]).mapInArrow(_nearest_page, "query_id long, q binary, page long, near double")
    to = liked.groupBy("query_id", "q").agg(F.max_by("page", F.struct("near", "page")).alias("page"))
    # distances to the pivot play no part where tau is open
    first = highest(pages.join(packed(to.withColumn("to_pivot", F.lit(0.0)).withColumn("tau", anything), "page", "long"), "page"))
    # a score at the low end of a long may stand for lower ones, so it bounds nothing
    worst = first.filter((F.col("rank") == k) & (F.col("score") > -(2**62))).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("tau"))
    known = cut(worst.groupBy("vec_id").agg(F.min("tau").alias("tau")), "bounds")
    rest = queries.join(known, "vec_id", "left").withColumn("tau", F.coalesce("tau", anything))
    return highest(pages.withColumn("part", part).join(route(rest, False), ["node", "part"])).select("query_id", "rank", "vec_id", "score")


def op9_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op9_mtree_topk": op9_mtree_topk}
ORACLE_SQL = {
    "op9_mtree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5"""
}

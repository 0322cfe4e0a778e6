"""Toxicity by a classifier chain over sparse word and prefix features.

The chain predicts low_quality, then toxic, the two categories that are labelled. Each link is a linear (logistic) model over the
presence of selected features and the probabilities of the links before it. In training those earlier
probabilities are out of fold: the link that gives them has not seen the document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import read_table
from weftwork.llm.words import U64, Words, slices

CATEGORIES = ("low_quality", "toxic")
#: Bounds of the labelled sample that training reads: texts of each toxic value, and code points of a text.
SAMPLE_EACH, SAMPLE_CHARS = 2000, 20_000
#: Selected features of a link, and folds.
SELECTED, FOLDS = 256, 5
#: Least signed root of chi-square of a selected feature: among many thousands of features lower values come by chance.
LEAST_Z = 4.5
PREFIXES = (2, 3, 4, 5, 6, 7, 8, 9, 10)
#: Probability from which a document counts as toxic where no labels tell (see best_threshold).
THRESHOLD = 0.3


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, feature hash): whole words and their prefixes."""
    yield words.doc, words.hash
    for _, at, h in words.prefixes(PREFIXES):
        yield words.doc[at], h


def text_features(texts: Sequence[str]) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        parts = list(_features(Words(texts[a:b])))
        doc, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(doc, kind="stable")
        bounds = np.searchsorted(doc[order], np.arange(b - a + 1))
        h = h[order]
        out += [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 0.1) -> np.ndarray:
    """Weights of a logistic model with the intercept last, by Newton steps that are halved until they help."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    beta[-1] = np.log((w @ y + 0.5) / (w @ (1 - y) + 0.5))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return w @ (np.logaddexp(0, z) - y * z) + penalty @ (b * b) / 2

    now = loss(beta)
    for _ in range(40):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        while (new := loss(beta + step)) > now and np.abs(step).max() > 1e-7:
            step = step / 2
        if new > now or np.abs(step).max() < 1e-5:
            break
        beta, now = beta + step, new
    return beta


def presence(sets: Sequence[np.ndarray], vocab: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocab)))
    if len(vocab):
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(s, vocab), max(len(s) - 1, 0))
            out[i] = (s[at] == vocab) if len(s) else 0
    return out


def _select(sets: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features most associated with y by a signed root of chi-square, in ascending order of hash."""
    yes = [s for s, v in zip(sets, y, strict=True) if v]
    if not yes or len(yes) == len(sets):
        return np.zeros(0, U64)
    h, a = np.unique(np.concatenate(yes), return_counts=True)
    h, a = h[a >= 3], a[a >= 3]
    if not len(h):
        return h
    b = np.zeros(len(h))
    no = np.concatenate([s for s, v in zip(sets, y, strict=True) if not v])
    at = np.minimum(np.searchsorted(h, no), len(h) - 1)
    b += np.bincount(at[h[at] == no], minlength=len(h))
    n1, n0 = len(yes), len(sets) - len(yes)
    share = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    best = np.lexsort((h, -z))[:SELECTED]
    return np.sort(h[best[z[best] > LEAST_Z]])


class Link:
    """One model of the chain."""

    def __init__(self, sets: Sequence[np.ndarray], earlier: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.vocab = _select(sets, y)
        self.beta = _logistic(np.hstack([presence(sets, self.vocab), earlier]), y, w)

    def predict(self, present: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return _sigmoid(np.hstack([present, earlier]) @ self.beta[:-1] + self.beta[-1])


def best_threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The probability from which to say yes: the one with the highest F2 (a miss counts as four false alarms), in the middle of its gap."""
    if not y.any() or y.all():
        return THRESHOLD
    order = np.argsort(-p, kind="stable")
    p, yes, no = p[order], np.cumsum((w * y)[order]), np.cumsum((w * (1 - y))[order])
    ends = np.append(p[1:] < p[:-1], True)
    f2 = np.where(ends, 5 * yes / (5 * yes + 4 * (yes[-1] - yes) + no), 0)
    k = int(f2.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


class Chain:
    """`names` with the links that predict them, in order, and the probability from which a text counts as toxic."""

    def __init__(self, names: Sequence[str], links: list[Link], threshold: float = THRESHOLD):
        self.names, self.links, self.threshold = tuple(names), links, threshold
        self.vocab = np.unique(np.concatenate([link.vocab for link in links])) if links else np.zeros(0, U64)
        self.columns = [np.searchsorted(self.vocab, link.vocab) for link in links]
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.vocab & U64(0xFFFF)).astype(np.int64)] = True

    def predict(self, texts: Sequence[str]) -> np.ndarray:
        """Probabilities, texts x names."""
        out = np.zeros((len(texts), len(self.names)))
        for a, b in slices(texts):
            present = np.zeros((b - a, len(self.vocab)))
            if len(self.vocab):
                for doc, h in _features(Words(texts[a:b])):
                    maybe = np.flatnonzero(self.low[(h & U64(0xFFFF)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
                    real = self.vocab[at] == h[maybe]
                    present[doc[maybe[real]], at[real]] = 1
            for k, link in enumerate(self.links):
                out[a:b, k] = link.predict(present[:, self.columns[k]], out[a:b, :k])
        return out


def train(texts: Sequence[str], toxic: np.ndarray, quality: np.ndarray, weights: np.ndarray, seed: int = 7) -> Chain:
    """The chain from labelled texts, with a threshold from out-of-fold probabilities. `weights` undo the sampling of the classes."""
    sets, threshold = text_features(texts), THRESHOLD
    fold = np.random.default_rng(seed).permutation(len(sets)) % FOLDS
    earlier, links = np.zeros((len(sets), 0)), []
    for name, y in zip(CATEGORIES, (1 - quality, toxic), strict=True):
        links.append(Link(sets, earlier, y, weights))
        out = np.zeros(len(sets))
        for f in range(FOLDS if len(sets) >= 2 * FOLDS else 0):
            fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            link = Link([sets[i] for i in fit], earlier[fit], y[fit], weights[fit])
            out[rest] = link.predict(presence([sets[i] for i in rest], link.vocab), earlier[rest])
        earlier = np.hstack([earlier, out[:, None]])
        if name == "toxic" and len(sets) >= 2 * FOLDS:
            threshold = best_threshold(out, y, weights)
    return Chain(CATEGORIES, links, threshold)


def fit_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """Trains on at most SAMPLE_EACH texts (of SAMPLE_CHARS code points at most) of each toxic value, chosen by a hash of
    doc_id. Labels with a null in any column are left out; a document labelled twice is toxic, or of low
    quality, if either label says so; of several texts of one doc_id the least is read. Without labels of both kinds every text gets the base rate.

    One task trains on the bounded sample; the driver receives the chain alone.
    """
    known = labels.select("doc_id", "toxic", "quality").dropna().groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"), (F.min("quality") > 0).cast("int").alias("quality"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["toxic"], r["doc_id"]))
        toxic, quality = (np.array([r[c] for r in rows], float) for c in ("toxic", "quality"))
        weights = np.zeros(len(rows))
        for value, size in sizes.items():
            weights[toxic == value] = size / max((toxic == value).sum(), 1)
        chain = train([r["text"] for r in rows], toxic, quality, weights / weights.mean() if len(rows) else weights)
        yield pa.RecordBatch.from_pydict({"chain": [pickle.dumps(chain)]})

    some = [known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_EACH) for value in (0, 1)]
    read = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    sample = read.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "toxic", "quality").agg(F.min("text").alias("text"))
    fitted = sample.repartition(1).mapInArrow(fit, "chain binary").first()
    return pickle.loads(fitted["chain"]) if fitted else train([], np.zeros(0), np.zeros(0), np.zeros(0))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with a probability column for each category of the chain; columns of those names are replaced.

    Null and empty texts get the probabilities of a text without words.
    """
    names = chain.names
    rest = docs.drop(*names)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.predict([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names)))], names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rest.schema), *(f"{n} double" for n in names)])
    return rest.mapInArrow(predict, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the probabilities of the chain, and toxic_pred: whether that of toxic reaches the chain's threshold."""
    docs = read_table(spark, sf_dir, "documents")
    chain = fit_chain(docs, read_table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), chain).select("doc_id", *(F.col(n).alias(f"p_{n}") for n in CATEGORIES), (F.col("toxic") >= chain.threshold).alias("toxic_pred"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}

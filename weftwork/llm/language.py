"""Language identification by a linear-chain conditional random field over words.

Every word gets emission scores from its affixes, its character n-grams and a lexicon of frequent words;
learned transitions link neighbours, so that runs of words in one language hold together and a switch within a
text is followed. Word posteriors come from forward-backward; a document's language is the one with the
highest mean posterior.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm.common import read_table
from weftwork.llm.words import U64, Words, mix, slices

#: Bounds of the labelled sample that training reads: texts of a language, and code points of a text.
SAMPLE_EACH, SAMPLE_CHARS = 150, 20_000
#: Hashed emission features, lexicon words of a language, and words of a block in forward-backward.
SPACE, LEXICON, BLOCK = 1 << 18, 3000, 64
UNDETERMINED = "und"


def _ngrams(words: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in which, hash) of the n-grams inside the words `which`."""
    count = np.maximum(words.length[which] - n + 1, 0)
    owner = np.repeat(np.arange(len(which)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + words.start[which][owner]
    h = np.full(len(owner), U64(n))
    for j in range(n):
        h = h * U64(0x100000001B3) + words.cp[at + j].astype(U64)
    return owner, mix(h)


def word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in which, feature in 0..SPACE-1), sorted by position."""
    parts = [_ngrams(words, which, n) for n in (2, 3)]
    spot = np.full(len(words.start), -1)
    spot[which] = np.arange(len(which))
    for suffix in (False, True):
        for _, at, h in words.prefixes((1, 2, 3, 4), suffix):
            mine = spot[at] >= 0
            parts.append((spot[at[mine]], h[mine]))
    parts.append((np.arange(len(which)), np.full(len(which), mix(np.array([77], U64))[0])))
    owner, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    return owner[order], (h[order] >> U64(46)).astype(np.int64)


class Crf:
    """languages; emission weights by hashed feature; lexicon hashes with their weights; transitions."""

    def __init__(self, languages: Sequence[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = list(languages), lexicon
        self.w = np.zeros((SPACE, n), np.float32)
        self.lex = np.zeros((len(lexicon) + 1, n), np.float32)  # the last row is for other words
        self.trans = np.zeros((n, n))

    def lexicon_row(self, h: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at, len(self.lexicon))

    def emissions(self, words: Words) -> np.ndarray:
        """Scores, words x languages; each distinct word is scored once."""
        h, which, back = np.unique(words.hash, return_index=True, return_inverse=True)
        owner, feature = word_features(words, which)
        starts = np.searchsorted(owner, np.arange(len(which)))
        e = np.add.reduceat(self.w[feature], starts, axis=0) + self.lex[self.lexicon_row(h)]
        return e[back].astype(np.float64)

    def posteriors(self, words: Words) -> np.ndarray:
        """The mean posterior of each language in each text; a text without words gets zeros."""
        n = len(self.languages)
        out = np.zeros((len(words.first) - 1, n))
        if len(words.hash) and n:
            p = forward_backward(self.emissions(words), words.first, self.trans)
            count = np.diff(words.first)
            full = np.flatnonzero(count)
            out[full] = np.add.reduceat(p, words.first[full], axis=0) / count[full, None]
        return out


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words of several chains; chain d holds words first[d] to first[d + 1]. With
    `pairs` also the expected number of times that each language follows each.

    Chains are cut into blocks of BLOCK words. The product of a block's transfer matrices is found for all
    blocks at once, messages then go from block to block, and last through all blocks at once again: exact, and
    with a number of numpy steps that the longest text hardly moves.
    """
    k = e.shape[1]
    a = np.exp(trans - trans.max())
    em = np.exp(e - e.max(1, keepdims=True))
    em = np.maximum(em, 1e-30)
    length = np.diff(first)
    blocks = -(-length // BLOCK)
    chain = np.repeat(np.arange(len(length)), blocks)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[chain] + nth * BLOCK
    size = np.minimum(BLOCK, first[chain + 1] - at)
    nb, first_block = len(chain), np.cumsum(blocks) - blocks
    order = np.argsort(-size, kind="stable")  # full blocks lead, so that a step works on a prefix
    at, size, opening = at[order], size[order], nth[order] == 0
    live = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
    prod = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for s in range(BLOCK):
        m = live[s]
        if not m:
            break
        p = prod[:m] @ a
        if not s:
            p[opening] = np.eye(k)
        p *= em[at[:m] + s][:, None, :]
        prod[:m] = p / p.sum((1, 2), keepdims=True)
    place = np.empty(nb, np.int64)
    place[order] = np.arange(nb)  # block in text order -> row here
    enter, leave = np.ones((nb, k)), np.ones((nb, k))
    longest = np.argsort(-blocks, kind="stable")
    counts = blocks[longest]
    for s in range(1, int(counts[0]) if len(counts) else 0):
        d = longest[: np.searchsorted(-counts, -s, side="left")]
        here, before = place[first_block[d] + s], place[first_block[d] + s - 1]
        v = np.einsum("ni,nij->nj", enter[before], prod[before])
        enter[here] = v / v.sum(1, keepdims=True)
        here, after = place[first_block[d] + blocks[d] - 1 - s], place[first_block[d] + blocks[d] - s]
        v = np.einsum("nij,nj->ni", prod[after], leave[after])
        leave[here] = v / v.sum(1, keepdims=True)
    alpha = np.empty_like(em)
    v = enter
    for s in range(BLOCK):
        m = live[s]
        if not m:
            break
        v = v[:m] @ a
        if not s:
            v[opening] = 1
        v *= em[at[:m] + s]
        v /= v.sum(1, keepdims=True)
        alpha[at[:m] + s] = v
    out = np.empty_like(em)
    beta, ahead = leave.copy(), np.empty_like(em)
    for s in range(BLOCK - 1, -1, -1):
        m = live[s]
        if not m:
            continue
        where = at[:m] + s
        p = alpha[where] * beta[:m]
        out[where] = p / p.sum(1, keepdims=True)
        ahead[where] = em[where] * beta[:m]
        b = ahead[where] @ a.T
        beta[:m] = b / b.sum(1, keepdims=True)
    if not pairs:
        return out
    inner = np.setdiff1d(np.arange(1, len(e)), first)
    both = alpha[inner - 1][:, :, None] * a * ahead[inner][:, None, :]
    return out, (both / both.sum((1, 2), keepdims=True)).sum(0)


def train(texts: Sequence[str], langs: Sequence[str], rounds: int = 3, seed: int = 3) -> Crf:
    """A field learned from texts whose words all count as of the text's language.

    Spans of 8 to 40 words from texts of all languages are strung together at random, so that
    transitions are learned from switched text. Gradients are expected less observed counts, with a step size of its own for each weight.
    """
    languages = sorted(set(langs))
    words = Words(list(texts), letters_only=True)
    if not languages or not len(words.hash):
        return Crf(languages, np.zeros(0, U64))
    label = np.array([languages.index(x) for x in langs])[words.doc]
    frequent = []
    for k in range(len(languages)):
        h, c = np.unique(words.hash[label == k], return_counts=True)
        keep = np.lexsort((h, -c))[:LEXICON]
        frequent.append(h[keep[c[keep] >= 5]])
    crf = Crf(languages, np.unique(np.concatenate(frequent)))
    n, rng = len(languages), np.random.default_rng(seed)
    h, which, back = np.unique(words.hash, return_index=True, return_inverse=True)
    owner, feature = word_features(words, which)
    starts = np.searchsorted(owner, np.arange(len(which) + 1))
    row = crf.lexicon_row(h)
    squares = [np.full(x.shape, 1e-6) for x in (crf.w, crf.lex, crf.trans)]

    def step(x: np.ndarray, square: np.ndarray, at: object, g: np.ndarray) -> None:
        square[at] += g * g
        x[at] -= 0.3 * g / np.sqrt(square[at])

    for _ in range(rounds):
        spans, i = [], 0
        while i < len(label):
            j = min(i + int(rng.integers(8, 40)), int(words.first[words.doc[i] + 1]))
            spans.append(np.arange(i, j))
            i = j
        rng.shuffle(spans)
        order = np.concatenate(spans)
        for a in range(0, len(order), 1 << 14):
            part = order[a : a + (1 << 14)]
            first = np.append(np.arange(0, len(part), 512), len(part))
            types, inside = np.unique(back[part], return_inverse=True)
            count = starts[types + 1] - starts[types]
            f = feature[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[types], count)]
            e = np.add.reduceat(crf.w[f], np.cumsum(count) - count, axis=0) + crf.lex[row[types]]
            p, gt = forward_backward(e[inside].astype(float), first, crf.trans, pairs=True)
            y = label[part]
            g = p.copy()
            g[np.arange(len(y)), y] -= 1
            inner = np.setdiff1d(np.arange(1, len(part)), first)
            np.add.at(gt, (y[inner - 1], y[inner]), -1)
            by_type = np.stack([np.bincount(inside, g[:, k], len(types)) for k in range(n)], 1)
            gw = np.stack([np.bincount(f, np.repeat(by_type[:, k], count), SPACE) for k in range(n)], 1)
            at = np.unique(f)
            step(crf.w, squares[0], at, gw[at] / len(y) + 1e-6 * crf.w[at])
            gl = np.zeros_like(crf.lex)
            np.add.at(gl, row[types], by_type)
            at = np.unique(row[types])
            step(crf.lex, squares[1], at, gl[at] / len(y))
            step(crf.trans, squares[2], slice(None), gt / len(y))
    return crf


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit_crf(docs: DataFrame) -> Crf:
    """Trains on at most SAMPLE_EACH texts (of SAMPLE_CHARS code points at most) of each language, chosen by a hash of doc_id among the rows
    with lang, text and doc_id whose crc32(doc_id) mod 4 is not 2.

    One pass ranks the ids, each task sending on its lowest of each language alone; a second reads the texts of those chosen. One
    task trains on the bounded sample, and the driver receives the field alone, which grows with the number of languages.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")) & (F.length("text") <= SAMPLE_CHARS))
    known = known.select("lang", "doc_id", "text", F.xxhash64("text").alias("h"))
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    ids = known.select("lang", "doc_id", "h").withColumn("nth", F.row_number().over(lowest)).filter(F.col("nth") <= SAMPLE_EACH).drop("nth")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r["lang"], r["doc_id"], r["text"]) for b in batches for r in b.to_pylist()})
        yield pa.RecordBatch.from_pydict({"crf": [pickle.dumps(train([r[2] for r in rows], [r[0] for r in rows]))]})

    sample = known.join(F.broadcast(ids.distinct()), ["lang", "doc_id", "h"], "left_semi").select("lang", "doc_id", "text")
    fitted = sample.repartition(1).mapInArrow(fit, "crf binary").first()
    return pickle.loads(fitted["crf"]) if fitted else train([], [])


def identify(docs: DataFrame, crf: Crf) -> DataFrame:
    """docs with lang_pred and score (the mean posterior of the words, 0 to 1); columns of these names are replaced.

    lang_pred is `und` with score 0 where text is null or has no letter, or nothing could be learned. Equal
    scores go to the language that comes first in the alphabet. Only the text is looked at.
    """
    rest = docs.drop("lang_pred", "score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            p = np.zeros((len(texts), max(len(crf.languages), 1)))
            for a, b in slices(texts):
                if crf.languages:
                    p[a:b] = crf.posteriors(Words(texts[a:b], letters_only=True))
            best = p.argmax(1)
            score = np.clip(p[np.arange(len(p)), best], 0, 1)
            names = [crf.languages[k] if s > 0 else UNDETERMINED for k, s in zip(best, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rest.schema), "lang_pred string, score double"])
    return rest.mapInArrow(predict, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_crf(docs))
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}

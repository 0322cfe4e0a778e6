"""Near-duplicate documents by Order MinHash over five-word shingles, verified by banded alignment of words.

For the sketch a text is the sequence of its five-word shingles, each labelled with how often it occurred before, so that
all are different. A sketch entry takes the two least labelled shingles under one hash function and keeps
them in text order; texts that agree in an entry are candidates. A candidate pair is a link if the longest common subsequence of its words, aligned
within the band of diagonals that the threshold allows, gives matched / (n_a + n_b - matched) >= 0.8: about one word in nine may be
another one. Classes are the connected components of the links.

Texts with the same words collapse to one representative first. In each bucket one member, the hub, is
compared with the others. Where that leaves a bucket in several components, its members, with those of other buckets of such a hub, are packed into blocks, and the tasks that hold two
blocks tell by a bitmap of the words which pairs from different components may be links (see `near`); only those are aligned. The members of a very
large bucket first meet again by a prefix filter in place
of the bucket: words, labelled with their occurrence, are put in ascending order of how many such members hold them, and two members
with a link share one of their first words, at places that their lengths bound (see `refined`). No
group of copies is expanded into rows for all its pairs, and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import read_table, running_sum, skew_join
from weftwork.llm.words import U64, Words, mix, shingle_hashes, slices
from weftwork.operators.rounds import cut, drop_scratch

THRESHOLD = 0.8
#: Entries of a sketch. One word in nine changed leaves 5/9 of the shingles, so a pair at the threshold agrees in an entry with about 0.15, in one of 24 with 0.98.
BANDS = 24
#: Rows of an alignment between moves of its window.
STEP = 64
#: Members that stand beside one copy of their hub, members of a packed block, and those of a bucket from which on its members meet by their words.
BLOCK, PACK, LARGE = 128, 512, 32_768
#: Pairs a member and round that are aligned of those that may be links, until in the last round all are. Copies that a hub has not joined are joined by a few.
MOST = (4, 64, None)
_MULT = mix(np.arange(1, 2 * BANDS + 1, dtype=U64)) | U64(1)


def labelled(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of shingle and occurrence number, bounds of the texts), in text order."""
    h, doc = shingle_hashes(words)
    order = np.lexsort((np.arange(len(h)), h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    group = np.flatnonzero(new)
    count = np.arange(len(h)) - np.repeat(group, np.diff(np.append(group, len(h))))
    occurrence = np.empty(len(h), U64)
    occurrence[order] = count.astype(U64)
    return mix(h + occurrence * U64(0xD6E8FEB86659FD93)), np.searchsorted(doc, np.arange(len(words.first)))


def sketches(label: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes of the entries, texts x BANDS; every text has a shingle at least."""
    start, n = bounds[:-1], np.diff(bounds)
    width = int(n.max()).bit_length() + 1
    keep, place = ~U64((1 << width) - 1), (np.arange(len(label)) - np.repeat(start, n)).astype(U64)
    last, alone = U64(2**64 - 1), n == 1
    out = np.zeros((len(n), BANDS), U64)
    for band in range(BANDS):
        v = (((label ^ _MULT[2 * band + 1]) * _MULT[2 * band]) & keep) | place
        one = (np.minimum.reduceat(v, start) & ~keep).astype(np.int64)
        v[start + one] = last
        two = (np.minimum.reduceat(v, start) & ~keep).astype(np.int64)
        two[alone] = 0
        h = mix(U64((band + 1) * 31) + label[start + np.minimum(one, two)])
        out[:, band] = mix(h * U64(31) + label[start + np.maximum(one, two)])
    return out


def text_key(own: np.ndarray, text: str) -> bytes:
    """128 bits that texts with the same words share; texts without words share them only if equal."""
    return hashlib.blake2b(own.tobytes() if len(own) else text.encode(), digest_size=16, person=b"words" if len(own) else b"raw").digest()


_SKETCH = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_ids, all_texts, digests = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["digest"].to_pylist()
        for a, b in slices(all_texts):
            texts = all_texts[a:b]
            words = Words(texts)
            label, bounds = labelled(words)
            bands = sketches(label, bounds).view(np.int64)
            rows = []
            for i, text in enumerate(texts):
                own = words.hash[words.first[i] : words.first[i + 1]]
                rows.append((text_key(own, text), len(own), bands[i].tolist() if len(own) else []))
            yield pa.RecordBatch.from_pydict({"doc_id": all_ids[a:b], "digest": digests[a:b], "key": [r[0] for r in rows], "n": [r[1] for r in rows], "bands": [r[2] for r in rows]}, schema=_SKETCH)


_SEQUENCE = pa.schema([("key", pa.binary()), ("seq", pa.binary())])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as 32 bits; a chance agreement moves a similarity by under 1 in its length."""
    for batch in batches:
        all_texts = batch["text"].to_pylist()
        for a, b in slices(all_texts):
            words = Words(all_texts[a:b])
            low = (words.hash >> U64(32)).astype(np.uint32)
            bounds = list(zip(words.first[:-1], words.first[1:], all_texts[a:b], strict=True))
            yield pa.RecordBatch.from_pydict({"key": [text_key(words.hash[s:e], text) for s, e, text in bounds], "seq": [low[s:e].tobytes() for s, e, _ in bounds]}, schema=_SEQUENCE)


class Lead:
    """A sequence of words that others are compared with: its different words, how often each occurs, and at which places, as bits."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        self.words, self.counts = np.unique(seq, return_counts=True)
        self.seq, self.places = seq, {}

    def shared(self, other: np.ndarray) -> int:
        """Words in common, in any order, each as often as both have it."""
        words, counts = np.unique(other, return_counts=True)
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        same = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        return int(np.minimum(self.counts[at[same]], counts[same]).sum())

    def aligned(self, other: np.ndarray, band: int) -> int:
        """The longest common subsequence whose matches lie on the diagonals up to `band` (and up to STEP more).

        A row of the alignment is an integer whose bits are clear where the row's best length grows; one addition carries all matches of a word. Only the bits
        of the band are kept, those that have left it are counted.
        """
        if not self.places:
            for i, w in enumerate(self.seq.tolist()):
                self.places[w] = self.places.get(w, 0) | 1 << i
        matched = low = 0
        width = STEP + band
        full = row = (1 << width) - 1
        words = other.tolist()
        for start in range(0, len(words), STEP):
            if (past := max(0, start - band) - low) > 0:
                matched += past - (row & ((1 << past) - 1)).bit_count()
                row, low = row >> past, low + past
            wider = start + STEP + band - low
            kept = width - past if past > 0 else width
            row |= ((1 << max(0, wider - kept)) - 1) << kept
            width, full = wider, (1 << wider) - 1
            for w in words[start : start + STEP]:
                if held := self.places.get(w):
                    hit = row & (held >> low)
                    row = ((row + hit) | (row - hit)) & full
        end = max(0, min(width, self.n - low))
        return matched + end - (row & ((1 << end) - 1)).bit_count()

    def compared(self, other: np.ndarray, threshold: float = THRESHOLD) -> tuple[float, int]:
        """(similarity, apart): matched / (n_a + n_b - matched), or 0 where it is under the threshold; and n_a + n_b - 2 matched, of a pair under the threshold only a
        lower bound of it, by the words in common in whatever order.

        A pair that reaches the threshold leaves at most (n_a + n_b) (1 - t) / (1 + t) words unmatched, so its alignment stays within as many diagonals.
        """
        total = self.n + len(other)
        need = threshold / (1 + threshold) * total - 1e-9
        shared = self.shared(other)
        if shared and shared >= need:
            matched = self.aligned(other, int(total - 2 * need + 1e-6))
            if matched >= need:
                return matched / (total - matched), total - 2 * matched
        return 0.0, total - 2 * shared

    def similarity(self, other: np.ndarray, threshold: float = THRESHOLD) -> float:
        return self.compared(other, threshold)[0]


def _beside(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """pairs(hub, rep, ...) with the sequence of rep, dealt and sorted so that each block of a hub's members follows a row with the hub's own
    sequence (rep null)."""
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = pairs.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).drop("blocks").join(seqs, "rep")
    leads = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(seqs.withColumnRenamed("rep", "hub"), "hub")
    return leads.unionByName(members, allowMissingColumns=True).repartition("hub", "block").sortWithinPartitions("hub", "block", F.asc_nulls_first("rep"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Lead, list[tuple[int, np.ndarray]]]]:
    """(columns of a batch, the hub's sequence, [(row, sequence)]) for each run of members of one hub."""
    lead = Lead(np.zeros(0, np.uint32))
    for batch in batches:
        columns = {name: batch[name].to_pylist() for name in batch.schema.names}
        run: list[tuple[int, np.ndarray]] = []
        for i, (rep, raw) in enumerate(zip(columns["rep"], columns["seq"], strict=True)):
            seq = np.frombuffer(raw, np.uint32)
            if rep is not None:
                run.append((i, seq))
                continue
            if run:
                yield columns, lead, run
            lead, run = Lead(seq), []
        if run:
            yield columns, lead, run


_PAIRS = "hub long, rep long, linked boolean, apart long"


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, lead, run in _members(batches):
            told = [lead.compared(seq, threshold) for _, seq in run]
            ends = [pa.array([columns[c][i] for i, _ in run], pa.int64()) for c in ("hub", "rep")]
            yield pa.RecordBatch.from_arrays([*ends, pa.array([x > 0 for x, _ in told]), pa.array([d for _, d in told], pa.int64())], names=["hub", "rep", "linked", "apart"])

    return verify


def numbered(raw: bytes) -> np.ndarray:
    """The words of a sequence, each with its occurrence, as different 64-bit tokens."""
    words = np.sort(np.frombuffer(raw, np.uint32)).astype(U64)
    at = np.arange(len(words))
    occurrence = at - np.maximum.accumulate(np.where(np.append(True, words[1:] != words[:-1])[: len(words)], at, 0))
    return mix(words | occurrence.astype(U64) << U64(32))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rep, raw in zip(batch["rep"].to_pylist(), batch["seq"].to_pylist(), strict=True):
            token = numbered(raw).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), rep)), pa.array(token), pa.array(np.full(len(token), len(token)))], names=["rep", "token", "distinct"])


def bitmap(raw: bytes) -> bytes:
    """At each bit whether an odd number of tokens falls there; four to eight bits a token, 512 at least."""
    token = numbered(raw)
    width = max(512, 1 << (4 * len(token) - 1).bit_length())
    odd = np.bincount((token & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["rep"], pa.array([bitmap(raw) for raw in batch["seq"].to_pylist()], pa.binary())], names=["rep", "bits"])


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of as many 64-bit words, as if they had been made so narrow."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


class Pack:
    """Members of one block whose bitmaps have one width, by ascending length."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["n"])
        self.bits = np.frombuffer(b"".join(r["bits"] for r in rows), U64).reshape(len(rows), -1)
        self.rep, self.n, self.comp = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "n", "comp"))
        self.short = np.array([r["short"] for r in rows], bool)

    @staticmethod
    def all_of(rows: list[dict]) -> list[Pack]:
        widths = sorted({len(r["bits"]) for r in rows})
        return [Pack([r for r in rows if len(r["bits"]) == w]) for w in widths]


def near(a: Pack, b: Pack, threshold: float, strip: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs from different components of a and b (each once, if b is a) that may be links.

    A token that only one of two texts has turns one bit, so at least as many tokens are unmatched as there are different bits, and a link leaves at most
    (n_a + n_b) (1 - t) / (1 + t). Bitmaps of a quarter of the width go first: unlike texts fail there.
    """
    full = min(a.bits.shape[1], b.bits.shape[1])
    wide, other = _folded(a.bits, full), _folded(b.bits, full)
    slim, few = _folded(wide, full // 4), _folded(other, full // 4)
    share = (1 - threshold) / (1 + threshold)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, len(a.n), strip):
        rows = slice(start, min(start + strip, len(a.n)))
        low = int(np.searchsorted(b.n, threshold * a.n[rows.start] - 1e-6))
        if a is b:
            low = max(low, start)
        high = int(np.searchsorted(b.n, a.n[rows.stop - 1] / threshold + 1e-6, "right"))
        apart = (a.comp[rows, None] != b.comp[None, low:high]) & (a.short[rows, None] | b.short[None, low:high])
        if not apart.any():
            continue
        most = (a.n[rows, None] + b.n[None, low:high]) * share + 1e-6
        apart &= np.bitwise_count(slim[rows, None, :] ^ few[None, low:high, :]).sum(2, dtype=np.int64) <= most
        i, j = np.nonzero(apart)
        i, j = i + start, j + low
        if a is b:
            i, j = i[i < j], j[i < j]
        kept = np.bitwise_count(wide[i] ^ other[j]).sum(1, dtype=np.int64) <= (a.n[i] + b.n[j]) * share + 1e-6
        kept &= np.minimum(a.n[i], b.n[j]) >= threshold * np.maximum(a.n[i], b.n[j]) - 1e-6
        found.append((i[kept], j[kept]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _rank(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each entry among those of the same id, by key."""
    order = np.lexsort((key, ids))
    first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])[: len(ids)])
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return out


def _near(threshold: float, most: int | None):
    """Pairs of two blocks, or of one with itself, that may be links; of each member `most` at least, and whether there are more."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, others = batch["own"][at].as_py(), batch["others"][at].as_py()
                a = Pack.all_of(own)
                b = a if others is None else Pack.all_of(others)
                pairs = [(x.rep[i], y.rep[j]) for k, x in enumerate(a) for y in (a[k:] if others is None else b) for i, j in [near(x, y, threshold)]]
                one, two = np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs])
                hub, rep = np.minimum(one, two), np.maximum(one, two)
                kept = np.ones(len(hub), bool)
                if most is not None and len(hub):
                    key = mix(mix(hub.astype(U64)) ^ rep.astype(U64))
                    kept = (_rank(hub, key) < most) | (_rank(rep, key) < most)
                more = pa.array(np.full(int(kept.sum()), not kept.all()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(hub[kept]), pa.array(rep[kept]), more], names=["hub", "rep", "more"])

    return told


def candidates(groups: DataFrame, threshold: float, most: int | None) -> DataFrame:
    """The pairs (hub, rep, more) within groups(id, rep, n, comp, short, size, bits) that may be links, of each member and two blocks `most` at least.

    A group is dealt into blocks of about PACK members, each one row; tasks get single blocks and pairs of blocks, so a pair of members is never a row.
    """
    blocks = F.ceil(F.col("size") / PACK).cast("int")
    dealt = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    packed = cut(dealt.groupBy("id", "blocks", "block").agg(F.collect_list(F.struct("rep", "n", "comp", "short", "bits")).alias("own")), "packed")
    single = packed.repartition("id", "block").select("own", F.lit(None).cast(packed.schema["own"].dataType).alias("others"))
    first = packed.filter("block < blocks - 1").select("id", F.col("block").alias("first"), "own", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    double = first.join(packed.select("id", "block", F.col("own").alias("others")), ["id", "block"]).repartition("id", "first", "block")
    out = cut(single.unionByName(double.select("own", "others")).mapInArrow(_near(threshold, most), "hub long, rep long, more boolean").distinct(), "near")
    drop_scratch(packed)
    return out


def refined(members: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Groups (id, rep, n, lead, comp, short) in which all of members(rep, n, lead, comp) meet that may have a link.

    A link of lengths n >= m needs o >= a (n + m) common tokens, with a = t / (1 + t), and m >= t n. Tokens are ordered by how many
    members hold them. If the first common one has place i in the longer and j in the shorter, then o <= n - i and
    o <= m - j, so i <= (1 - t) n, j <= (1 - 2 a) m and m <= (n - i) / a - n. So the shorter one (`short`) goes to the groups of
    its class of lengths and its first tokens, the longer one to those of its first tokens and the classes that it can have a
    link with. Tokens that no other member holds lead nowhere; they only take the first places.
    """
    a = threshold / (1 + threshold)

    def length_class(n: Column) -> Column:
        return F.floor(F.log(F.greatest(n, F.lit(1.0))) / np.log(1.1)).cast("int")

    tokens = cut(seqs.join(members.select("rep"), "rep", "left_semi").mapInArrow(_tokens, "rep long, token long, distinct long"), "tokens")
    several = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    shared = tokens.join(several, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("_t"), F.first("distinct").alias("_u"))
    n, place = F.col("n"), F.col("_u") - F.size("_t")
    longer, shorter = F.floor((1 - threshold) * n + 1e-6) + 1, F.floor((1 - 2 * a) * n + 1e-6) + 1
    first = shared.join(members, "rep").withColumn("_place", place).withColumn("_t", F.slice("_t", 1, F.greatest(F.lit(0), longer - place).cast("int")))
    first = first.select("rep", "n", "lead", "comp", "_place", F.posexplode("_t").alias("_k", "_t")).withColumn("_place", F.col("_place") + F.col("_k"))
    own = F.array(F.struct(length_class(n).alias("kind"), F.lit(True).alias("short")))
    most = length_class(F.least(n, (n - F.col("_place")) / a - n + 1e-6))
    other = F.transform(F.sequence(length_class(threshold * n - 1e-6), most), lambda c: F.struct(c.alias("kind"), F.lit(False).alias("short")))
    other = F.when(most >= length_class(threshold * n - 1e-6), other).otherwise(F.array().cast("array<struct<kind:int,short:boolean>>"))
    roles = F.when(F.col("_place") < shorter, F.concat(own, F.filter(other, lambda r: r["kind"] != length_class(n)))).otherwise(other)
    met = first.select("rep", "n", "lead", "comp", F.col("_t.token").alias("_token"), F.explode(roles).alias("_r"))
    out = cut(met.select(F.xxhash64("_token", "_r.kind").alias("id"), "rep", "n", "lead", "comp", F.col("_r.short").alias("short")), "refined")
    drop_scratch(tokens)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of links(a, b): comp is the least id of the component. Least labels spread along links, and labels of labels are taken, until nothing changes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("heard"))
        spread = labels.join(heard, "id").select("id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jumped = spread.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("further")), "comp", "left")
        new = cut(jumped.select("id", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "was"), "labels")
        drop_scratch(labels)
        if new.filter("was <> comp").isEmpty():
            drop_scratch(both)
            return new
        labels = new


def joined(comps: DataFrame, found: DataFrame) -> DataFrame:
    """comps(id, comp) with the links found(a, b) taken up: the components that are there are joined, none is worked out anew."""
    def named(rows: DataFrame, end: str) -> DataFrame:
        at = comps.select(F.col("id").alias(end), F.col("comp").alias(f"_{end}"))
        return rows.join(at, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))

    ends = cut(named(named(found.select("a", "b"), "a"), "b"), "ends")
    fresh = ends.select("a", "_a").unionByName(ends.select(F.col("b").alias("a"), F.col("_b").alias("_a"))).toDF("id", "comp")
    known = comps.unionByName(fresh).distinct()
    apart = cut(ends.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "apart")
    if not apart.isEmpty():
        merged = components(apart)
        known = known.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("_new")), "comp", "left").select("id", F.coalesce("_new", "comp").alias("comp"))
    out = cut(known, "components")
    drop_scratch(ends, apart)
    return out


def _open(groups: DataFrame) -> DataFrame:
    """The rows of groups that hold several components and a member that may be the shorter of a pair, with the group's size and least component."""
    state = groups.groupBy("id").agg(F.count("*").alias("size"), F.max("short").alias("_any"), F.min("comp").alias("low"), F.max("comp").alias("_high"))
    return groups.join(state.filter("_any AND low < _high").select("id", "size", "low"), "id")


def _reachable(rows: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """rows(rep, n, lead, comp, hub, linked, apart) as groups (id, rep, n, lead, comp, short), one for all hubs of a component, without members that are linked to the hub and too
    far from all that the hub meets outside of its component.

    n_a + n_b - 2 matched is a metric, and a link to a member of n words is at most n (1 - t) / t long. So a member at a distance d from the hub has no link to
    others whose distances from it all exceed d + n (1 - t) / t. Copies of one text leave the buckets that they share with unlike texts in this way.
    """
    hub_comp = comps.select(F.col("id").alias("hub"), F.col("comp").alias("_hub_comp"))
    known = rows.join(hub_comp, "hub", "left").withColumn("id", F.coalesce("_hub_comp", "hub")).withColumn("_out", F.col("comp") != F.col("id"))
    outside = known.filter("_out").groupBy("hub").agg(F.min("apart").alias("_least"))
    reach = F.col("apart") + F.col("n") * ((1 - threshold) / threshold) + 1e-6
    kept = known.join(outside, "hub").filter(F.col("_out") | ~F.col("linked") | (reach >= F.col("_least")))
    return kept.select("id", "rep", "n", "lead", "comp", F.lit(True).alias("short")).distinct()


def linked_groups(buckets: DataFrame, seqs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The links(a, b) that were tested within buckets(id, rep, n, lead), and the components(id, comp) that all links make.

    The first round compares each bucket's hub with its other members. The buckets whose hubs have come into one component go on as one group. In what is open then, the pairs
    from different components that may be links are told from packed blocks and aligned, in each round of MOST more of a member's, until there are none left. Groups of more than LARGE
    members are refined before.
    """
    spark = buckets.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "id long, comp long")

    def test(pairs: DataFrame) -> DataFrame:
        """Tells which of pairs(hub, rep) are links, and takes them up."""
        nonlocal links, comps
        fresh = cut(pairs.distinct(), "pairs")
        told = cut(_beside(fresh, seqs).mapInArrow(_verify(threshold), _PAIRS), "tested")
        found = cut(told.filter("linked").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct(), "links")
        if not found.isEmpty():
            before, links = (links, comps), cut(links.unionByName(found).distinct(), "links")
            comps = joined(comps, found)
            drop_scratch(*before)
        drop_scratch(fresh, found)
        return told

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    hubs = buckets.groupBy("id").agg(F.min(F.struct("lead", "rep")).alias("_hub")).select("id", F.col("_hub.rep").alias("hub"))
    met = cut(buckets.join(hubs, "id").select("hub", "rep", "n", "lead").distinct(), "met")
    told = test(met.filter("rep <> hub").select("hub", "rep"))
    # a hub is linked to itself, so it stays where another member may reach what is outside
    rows = met.join(told.select("hub", "rep", "linked", "apart"), ["hub", "rep"], "left").fillna({"linked": True, "apart": 0})
    still = cut(_open(_reachable(placed(rows), comps, threshold)).drop("low"), "open")
    drop_scratch(met, told)
    groups = still.filter(F.col("size") <= LARGE).select("id", "rep", "n", "short", "size")
    large, made = still.filter(F.col("size") > LARGE), []
    if not large.isEmpty():
        members = cut(large.select("rep", "n", "lead", "comp").distinct(), "members")
        made = [members, refined(members, seqs, threshold)]
        groups = groups.unionByName(_open(made[1]).select("id", "rep", "n", "short", "size"))
    bits = seqs.join(groups.select("rep").distinct(), "rep", "left_semi").mapInArrow(_bitmaps, "rep long, bits binary")
    rest = cut(groups.join(bits, "rep"), "rest")
    drop_scratch(still, *made)
    for most in MOST:
        pairs = candidates(placed(rest), threshold, most)
        if not pairs.isEmpty():
            drop_scratch(test(pairs.select("hub", "rep")))
        whole = pairs.filter("more").isEmpty()
        drop_scratch(pairs)
        if whole:
            break
    drop_scratch(rest)
    return links, comps


def text_digest(text: str = "text") -> Column:
    """Tells the texts of one doc_id apart."""
    return F.unhex(F.md5(text))


def near_duplicate_texts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest (text_digest), class_id, n_links_tested for every row of docs; see near_duplicates."""
    known = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sketched = cut(known.withColumn("digest", text_digest()).mapInArrow(_sketch, "doc_id long, digest binary, key binary, n long, bands array<long>"), "sketches")
    least = cut(sketched.groupBy("key").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("copies"), F.lit(1).alias("one")), "least")
    # representatives are numbered by doc_id and key, as several texts may share their least doc_id
    reps = cut(running_sum(least, [], ["least_doc", "key"], "one", "rep").drop("one"), "representatives")
    drop_scratch(least)
    own = sketched.join(reps.select("key", "rep", F.col("least_doc").alias("doc_id")), ["key", "doc_id"]).dropDuplicates(["key"])
    entries = own.select("rep", "n", F.explode("bands").alias("h"))
    met = entries.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = cut(entries.join(met, "h"), "buckets")
    # the member that meets most others leads: the original of many edited copies does
    weight = buckets.groupBy("rep").agg((-F.sum("size")).alias("lead"))
    groups = cut(buckets.join(weight, "rep").select(F.col("h").alias("id"), "rep", "n", "lead"), "groups")
    wanted = cut(reps.join(weight.select("rep"), "rep").select("key", "rep", F.col("least_doc").alias("doc_id")), "wanted")
    made = known.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sequences, "key binary, seq binary").dropDuplicates(["key"])
    seqs = cut(made.join(wanted.select("key", "rep"), "key").select("rep", "seq"), "sequences")
    links, comps = linked_groups(groups, seqs, threshold)
    drop_scratch(buckets, groups, wanted, seqs)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links_tested"))
    linked = reps.select("rep", "least_doc").join(comps.select(F.col("id").alias("rep"), "comp"), "rep")
    joined = linked.groupBy("comp").agg(F.min("least_doc").alias("class_id"), F.count("*").alias("members"))
    placed_in = skew_join(linked.select("rep", "comp"), joined, ["comp"], "members").select("rep", "class_id")
    named = reps.join(placed_in, "rep", "left").join(degree, "rep", "left")
    classes = named.select("key", F.coalesce("class_id", "least_doc").alias("class_id"), F.coalesce("n_links_tested", F.lit(0)).cast("long").alias("n_links_tested"), "copies")
    out = skew_join(sketched.select("doc_id", "digest", "key"), classes, ["key"], "copies").select("doc_id", "digest", "class_id", "n_links_tested")
    rest = docs.filter(F.col("doc_id").isNull() | F.col("text").isNull()).select("doc_id", text_digest().alias("digest"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links_tested"))
    result = cut(out.unionByName(rest), "classes")
    drop_scratch(sketched, reps, links, comps)
    return result


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links_tested for every row of docs.

    class_id is the least doc_id of the document's class; n_links_tested counts those links of its representative, whose
    words it shares, that the order of the hubs put to the test. It is a lower bound: pairs of a class that is joined already are not compared. Null text, and rows without doc_id, make classes of their own (class_id = doc_id). Texts without words
    are copies only of equal texts. Each text of a repeated doc_id is classed for itself: classes of different texts may then
    bear the same class_id. Other columns are not read.
    """
    return near_duplicate_texts(docs, threshold).drop("digest")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLE_SQL: dict[str, str] = {}

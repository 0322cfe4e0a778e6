"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import fingerprints, language, line_dedup, mixing, near_dedup, packing, sharding, suffix_dedup, topk, toxicity

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(12_000))
ROWS = [
    (1, None, "en", "src1"), (2, "", None, "src2"), (3, "one two three four five six\nseven eight nine ten", "en", "src1"), (4, "one two three four five six\nseven eight nine ten", "en", None),
    (5, LONG, "fr", "src3"), (6, LONG + " tail", "fr", "src3"), (7, "\n\n\n", "de", "odd"), (8, "### 123 !!!", "de", "src4"), (9, "été à Noël 中文 \U0001f600", "fr", "src1"),
    (3, "one two three four five six\nseven eight nine ten", "en", "src1"), (None, "text without an id of its own", "en", "src2"), (None, None, None, None), (10, "x" * 70_000, "en", "src1"), (11, "x" * 60, "en", "src1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS], SCHEMA)
    clash = ["row", "key", "n_lines", "tokens", "_key", "label", "toxic", "score", "chunk", "budget", "rank", "part"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 - (i % 3 == 0)) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (4, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def nothing(df):
    return df.limit(0)


def test_line_dedup(docs):
    got = line_dedup.drop_repeated_lines(docs, batches=2)
    assert set(docs.columns) | {"n_dropped"} == set(got.columns)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == len(ROWS)
    assert rows[4, ""].n_dropped == 2 and rows[3, ROWS[2][1]].n_dropped == 0 and rows[1, None].n_lines == 1 and rows[7, "\n\n\n"].n_lines == 4
    assert line_dedup.drop_repeated_lines(nothing(docs)).count() == 0


def test_mixing(docs):
    got = mixing.choose(docs).collect()
    assert sum(r.full_epochs * r.tokens + r.part_tokens for r in got) <= sum(len((r[1] or "").split()) for r in ROWS)
    assert {r.doc_id for r in got} <= {3, 4, 5, 6, 8, 9, 10, 11, None}
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r.full_epochs + (r.part_tokens > 0) for r in got)
    assert mixing.choose(nothing(docs)).count() == 0


def test_internal_names_may_clash(docs):
    """Columns named like those that the operators add on the way pass through as they are."""
    names = ["_lines", "_drops", "_kept", "_gone", "_split", "_text_hash", "_row", "_times", "_nth", "_copy"]
    frame = docs.withColumns({c: F.lit(c) for c in names})
    for got in (line_dedup.drop_repeated_lines(frame, batches=2), mixing.mix(frame)):
        rows = got.collect()
        assert rows and all(r[c] == c for r in rows for c in names)


def test_line_dedup_takes_time_in_proportion_to_lines(spark):
    text = "\n".join(f"line number {i} of many" for i in range(100_000))
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame([(1, text), (2, "first\n" + text + "\nlast")], "doc_id long, text string"), batches=1).collect()}
    assert got[1].text == text and got[2].text == "first\nlast" and got[2].n_dropped == 100_000


def test_language(docs):
    crf = language.fit_crf(docs)
    got = {(r.doc_id, r.text): r for r in language.identify(docs, crf).collect()}
    assert len(got) == len(ROWS) - 1
    assert got[1, None].lang_pred == got[8, "### 123 !!!"].lang_pred == got[2, ""].lang_pred == "und"
    assert all(0 <= r.score <= 1 and r.label == "clash" for r in got.values())
    assert language.identify(nothing(docs), crf).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit_crf(nothing(docs))).collect()} == {"und"}


def test_near_dedup(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.class_id for r in got}
    assert by[4] == 3 and by[6] == 5 and by[1] == 1 and by[2] == 2 and by[7] == 7 and by[None] is None
    assert near_dedup.near_duplicates(nothing(docs)).count() == 0


def test_near_dedup_of_a_repeated_doc_id(spark):
    base = [f"w{i}" for i in range(300)]
    copy, edited = " ".join(base), " ".join([*base[:150], "new", *base[151:]])
    other, far = " ".join(f"a{i}" for i in range(300)), " ".join([*[f"a{i}" for i in range(299)], "end"])
    rows = [(1, copy), (5, edited), (5, other), (5, other), (9, far), (5, "alone without a copy of five words"), (9, "alone too and as long as that")]
    frame = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(frame).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (5, 5), (5, 5), (9, 5), (9, 9)]
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_near(spark, frame, "").collect())
    assert kept == sorted([(1, copy), (5, other), (5, other), (5, "alone without a copy of five words"), (9, "alone too and as long as that")])


def test_packing(docs):
    got = packing.pack(docs, sequence=64, window=2).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 2 * next(r.doc_tokens for r in got if r.doc_id == 3)
    assert next(r.length for r in got if r.doc_id == 1) == 1
    places = sorted((r.sequence_id * 64 + r.offset, r.length) for r in got)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert packing.pack(nothing(docs)).count() == 0


def test_fingerprints(docs):
    got = fingerprints.fingerprint_with_next(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[3].fingerprint == by[4].fingerprint and by[1].n_chars == 0 and by[1].fingerprint == by[2].fingerprint
    assert fingerprints.fingerprint_with_next(nothing(docs)).count() == 0
    alone = fingerprints.fingerprint_with_next(docs.filter("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_sharding(docs):
    got = sharding.shard_rows(docs, 4).collect()
    assert len(got) == len(ROWS) and sorted((r.shard, r.slot) for r in got) == sorted((p % 4, p // 4) for p in range(len(ROWS)))
    assert all(r.text_crc32 == zlib.crc32((dict((x[0], x[1]) for x in ROWS)[r.doc_id] or "").encode()) for r in got if r.doc_id not in (None,))
    assert sharding.shard_rows(nothing(docs)).count() == 0


def test_suffix_dedup(docs):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[4].n_removed == 0  # under 50 bytes
    assert by[6].n_removed == len(LONG) and bytes(by[6].kept) == b" tail" and by[6].n_spans == 1
    assert by[5].n_removed == 0 and by[10].n_removed == 0 and by[11].n_removed == 60
    assert suffix_dedup.remove_repeats(nothing(docs)).count() == 0


def test_topk(spark):
    v = [(i, [float(i % 3), 0.5, -0.25]) for i in range(12)] + [(20, None), (21, [1.0, None, 2.0]), (22, [float("nan")] * 3), (23, [float("inf")] * 3), (24, []), (None, [1.0] * 3), (25, [1.0]), (50, [2.0]), (3, [9.0] * 3)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = [(i, [int(256 * x // 1) for x in e]) for i, e in v if i is not None and e and all(x is not None and abs(x) < 1e9 for x in e)]
    for i, a in q:
        if i % 5 == 0:
            all_ = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in q if j != i and len(a) == len(b))[:5]
            assert sorted(got.get(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(all_)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_topk_wide_and_hot(spark):
    """Components of 1e6 to 1e300 get exact scores (cut to a long), and a third of the vectors are one and the same."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(3000)] + [(i, [0.25, -0.5, 1.0, 0.75]) for i in range(3000, 4500)]
    rows += [(i, rng.normal(0, 1e6, 4).tolist()) for i in range(4500, 4600)] + [(5000, [1e300] * 4), (5050, [-1e300, 1.0, 1.0, 1.0]), (5001, [1.7e308, 0.0, 0.0, 0.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    top = float(np.finfo(float).max)
    whole = {i: [int(max(min(np.floor(256 * x), top), -top)) for x in e] for i, e in rows}
    for i in (0, 50, 2950, 3000, 4450, 4500, 4550, 5000, 5050):
        want = sorted((-min(max(sum(a * b for a, b in zip(whole[i], x, strict=True)), -(2**63)), 2**63 - 1), j) for j, x in whole.items() if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)], i
    assert len(got) == sum(i % 50 == 0 for i in whole)


def test_toxicity(docs, labels):
    chain = toxicity.fit_chain(docs, labels)
    got = toxicity.score(docs, chain)
    assert got.count() == len(ROWS) and set(got.columns) == set(docs.columns) | set(chain.names)
    assert all(0 <= r[c] <= 1 for r in got.collect() for c in chain.names)
    assert toxicity.score(nothing(docs), chain).count() == 0
    bare = toxicity.fit_chain(docs, nothing(labels))
    assert toxicity.score(docs, bare).count() == len(ROWS)


def test_pipeline_stages_take_edges(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / "stages" / name))
        frame = spark.read.parquet(str(tmp_path / "stages" / name))
        if name != "packing":
            assert frame.columns == corpus_pipeline.COLUMNS

import random

from weftwork.operators import versions as V

LOG = "graph string, s string, p string, o string, version long, added boolean, _code int, until int"


def states(rows, last):
    """Brute force: the set of quads after each version from -2 to last."""
    now, out = set(), {}
    for v in range(-2, last + 1):
        now -= {r[:4] for r in rows if r[4] == v and r[5] is False}
        now |= {r[:4] for r in rows if r[4] == v and r[5] is True}
        out[v] = set(now)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_replay(spark):
    rng = random.Random(4)
    quads = [(g, s, "p", o) for g in ("g", None) for s in ("a", "b") for o in ("c", None)]
    rows = [(*rng.choice(quads), rng.choice([None, *range(-2, 9)]), rng.choice([True, False, None])) for _ in range(160)]
    rows += rows[:20]
    log = spark.createDataFrame([(*r, 1, 1) for r in rows], LOG)
    want = states(rows, 9)
    for v in (-3, -2, 0, 3, 9):
        have = want.get(v, set())
        assert set(rows_of(V.as_of(log, v))) == have
        assert set(rows_of(V.triples(log, v, ["g"]))) == {q[1:] for q in have if q[0] == "g"}
        since = {}
        for q in have:
            w = v
            while q in want.get(w - 1, ()):
                w -= 1
            since[q] = w
        assert rows_of(V.provenance(log, v)) == sorted(((q[1], q[2], q[3], q[0], w) for q, w in since.items()), key=repr)
    for old, new in ((0, 5), (5, 0), (-3, 9)):
        a, b = want.get(old, set()), want[new]
        assert rows_of(V.difference(log, old, new)) == sorted([(*q, "added") for q in b - a] + [(*q, "removed") for q in a - b], key=repr)
    spans = V.intervals(log).collect()
    for v in range(-2, 10):
        held = [tuple(r[:4]) for r in spans if r.since <= v and (r.until is None or v < r.until)]
        assert len(held) == len(set(held)) and set(held) == want[v]
    assert all(r.until is None or tuple(r[:4]) not in want[r.until] for r in spans)
    small = V.compact(log, 4)
    assert all(set(rows_of(V.as_of(small, v))) == want[v] for v in (4, 6, 9))


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    for df in (V.as_of(log, 1), V.difference(log, 0, 1), V.intervals(log), V.provenance(log, 1), V.compact(log, 1)):
        assert df.count() == 0

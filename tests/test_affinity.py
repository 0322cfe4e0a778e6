"""Pairs, gaps and recommendations against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from weftwork.operators import affinity, rounds


def links_by_hand(lines, widest, least, links):
    baskets = defaultdict(set)
    for b, i in lines:
        if b is not None and i is not None:
            baskets[b].add(i)
    baskets = {b: s for b, s in baskets.items() if len(s) <= widest}
    n, total = Counter(i for s in baskets.values() for i in s), len(baskets)
    both = Counter((a, b) for s in baskets.values() for a in s for b in s if a != b)

    def x(v):
        return v * math.log(v) if v else 0.0

    out = {}
    for a in n:
        found = []
        for b in n:
            k = both[a, b]
            if k >= least and k * total > n[a] * n[b]:
                p, q = min(a, b), max(a, b)
                g = x(k) + x(n[p] - k) + x(n[q] - k) + x(total - n[p] - n[q] + k) + x(total) - x(n[p]) - x(total - n[p]) - x(n[q]) - x(total - n[q])
                found.append((-math.floor(2000 * g + 0.5), b))
        out[a] = [(b, -w) for w, b in sorted(found)[:links]]
    return out, both


def sample():
    rng, lines = random.Random(2), []
    for b in range(150):
        mine = rng.sample(range(12), 3) if b % 2 else rng.sample(range(10, 40), 4)
        lines += [(b, i) for i in mine]
    lines += [(7, i) for i in range(30)] + [(1000, i) for i in range(40)]  # one wide basket, one too wide
    return [*lines, *lines[:20], (None, 1), (3, None)]


def test_gaps(spark):
    lines = sample()
    links, both = links_by_hand(lines, 35, 2, 4)
    want = defaultdict(lambda: [0, 0])
    for a, to in links.items():
        for m, w in to:
            for c, v in links[m]:
                if c != a and not both[a, c]:
                    want[a, c][0] += 1
                    want[a, c][1] += min(w, v)
    got = affinity.gaps(spark.createDataFrame(lines, "basket long, item long"), widest=35, links=4).collect()
    assert want and {(r.item, r.other): [r.between, r.score] for r in got} == dict(want)


def test_recommendations_and_reasons(spark):
    lines = sample()
    links, _ = links_by_hand(lines, 35, 2, 4)
    rng = random.Random(9)
    held = [(u, rng.randrange(40)) for u in range(12) for _ in range(u)] + [(None, 3), (3, None)]
    mine = defaultdict(set)
    for u, i in held:
        if u is not None and i is not None:
            mine[u].add(i)
    want = {}
    for u, own in mine.items():
        given = defaultdict(list)
        for i in own:
            for j, w in links.get(i, []):
                if j not in own:
                    given[j].append((-w, i))
        best = sorted(given, key=lambda j: (sum(w for w, _ in given[j]), j))[:3]
        for r, j in enumerate(best):
            want[u, r + 1] = (j, -sum(w for w, _ in given[j]), [i for _, i in sorted(given[j])[:2]])
    frame = spark.createDataFrame(lines, "basket long, item long")
    got = affinity.recommendations(spark.createDataFrame(held, "user long, item long"), frame, k=3, reasons=2, widest=35, links=4).collect()
    assert want and {(r.user, r["rank"]): (r.item, r.score, r.reasons) for r in got} == want
    assert affinity.recommendations(spark.createDataFrame([], "user long, item long"), frame).count() == 0
    assert affinity.gaps(frame.limit(0)).count() == 0


def test_more_lines_are_dealt_over_more_tasks(spark):
    """The number of tasks follows the rows, and the session's own settings come back, also after an error."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(RuntimeError), rounds.small_tasks(spark, 10_000_000):
        assert spark.conf.get(names[0]) == "40"
        raise RuntimeError
    with rounds.small_tasks(spark, 10):
        assert spark.conf.get(names[0]) == before[0]
    assert [spark.conf.get(n) for n in names] == before
    spark.conf.set(names[1], "16k")
    with rounds.small_tasks(spark, 10):
        assert spark.conf.get(names[1]) == "16384b" and spark.conf.get(names[2]) == f"{32 << 20}b"
    spark.conf.set(names[1], before[1])
    assert [rounds._bytes(x) for x in ("64MB", "8m", "1024", "128k", "67108864b")] == [64 << 20, 8 << 20, 1024, 128 << 10, 64 << 20]

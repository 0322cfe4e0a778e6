"""Path patterns against a walk in plain Python."""

import random

import pytest

from weftwork.operators import paths
from weftwork.operators.paths import any_number, back, chain, either, maybe, some, step

PATTERNS = [
    step("a"), back("b"), some(step("a")), any_number(step("a")), chain(step("a"), any_number(back("b")), step("c")), either(step("a"), chain(step("b"), step("c"))),
    some(either(step("a"), back("b"))), chain(maybe(step("a")), some(chain(step("b"), step("c")))), any_number(chain(maybe(step("a")), maybe(back("c")))), chain(some(some(step("c"))), maybe(either(back("a"), back("b")))),
]


def pairs(p, edges, nodes):
    """All (from, to) of the pattern, by sets of pairs."""
    if p.kind == "step":
        out = {(b, a) if p.inverse else (a, b) for a, label, b in edges if label == p.label}
    elif p.kind == "either":
        out = set().union(*(pairs(x, edges, nodes) for x in p.parts))
    else:
        out = {(n, n) for n in nodes} if p.kind == "chain" else pairs(p.parts[0], edges, nodes)
        for x in p.parts if p.kind == "chain" else ():
            more = pairs(x, edges, nodes)
            out = {(a, c) for a, b in out for b2, c in more if b == b2}
        while p.kind == "loop" and (new := {(a, c) for a, b in out for b2, c in out if b == b2} - out):
            out |= new
    return out | {(n, n) for n in nodes} if p.may_skip else out


@pytest.mark.parametrize("pattern", PATTERNS, ids=range(len(PATTERNS)))
def test_patterns_against_sets_of_pairs(spark, pattern):
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(9)]
    edges = [(rng.choice(nodes), rng.choice("abc"), rng.choice(nodes)) for _ in range(16)]
    seeds = nodes[:4]
    graph = spark.createDataFrame([*edges, edges[0], (None, "a", "n1"), ("n1", "a", None), ("n1", None, "n2")], "src_iri string, label string, dst_iri string")
    got = paths.reached(graph, spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "iri string"), pattern).collect()
    assert len(got) == len(set(got))
    assert {(r.seed, r.iri) for r in got} == {x for x in pairs(pattern, edges, nodes) if x[0] in seeds}


def test_no_edges_and_no_seeds(spark):
    edges = spark.createDataFrame([], "src_iri string, label string, dst_iri string")
    seeds = spark.createDataFrame([("x",)], "iri string")
    assert paths.reached(edges, seeds, some(step("a"))).count() == 0
    assert [tuple(r) for r in paths.reached(edges, seeds, any_number(step("a"))).collect()] == [("x", "x")]
    assert paths.reached(edges, seeds.limit(0), any_number(step("a"))).count() == 0

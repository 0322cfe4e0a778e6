"""Regular path queries: which nodes a pattern of edges leads to.

A pattern is a value made of step, back, chain, either, some, any_number and maybe, such as chain(some(step("is_a")), back("placed")). It becomes an automaton
with one state a step, and a search walks the product of graph and automaton from the bound nodes: a frontier of (seed, node, state) meets the
edges of the labels that its states wait for, and what was seen before falls out, so cycles end. No closure of the graph is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.rounds import cut, drop_scratch


@dataclass(frozen=True)
class Pattern:
    """kind is step, chain, either or loop; loop repeats its part once or more; may_skip adds the empty path."""

    kind: str
    label: str = ""
    inverse: bool = False
    parts: tuple[Pattern, ...] = ()
    may_skip: bool = False


def step(label: str) -> Pattern:
    return Pattern("step", label)


def back(label: str) -> Pattern:
    """An edge of the label against its direction."""
    return Pattern("step", label, True)


def chain(*parts: Pattern) -> Pattern:
    return Pattern("chain", parts=parts)


def either(*parts: Pattern) -> Pattern:
    return Pattern("either", parts=parts)


def some(part: Pattern) -> Pattern:
    """Once or more."""
    return Pattern("loop", parts=(part,))


def any_number(part: Pattern) -> Pattern:
    return Pattern("loop", parts=(part,), may_skip=True)


def maybe(part: Pattern) -> Pattern:
    return Pattern("chain", parts=(part,), may_skip=True)


class Automaton(NamedTuple):
    """moves: (state, label, inverse, next); state 0 is the start, every other state is a step that was taken last."""

    moves: list[tuple[int, str, bool, int]]
    accepting: set[int]


def automaton(pattern: Pattern) -> Automaton:
    """One state for each step of the pattern, in the order in which they stand; which step may follow which gives the moves."""
    steps: list[Pattern] = []
    follow: dict[int, set[int]] = {}

    def build(p: Pattern) -> tuple[bool, set[int], set[int]]:
        """Whether p may be empty, the steps it can begin with and those it can end with."""
        if p.kind == "step":
            steps.append(p)
            own = len(steps)
            follow[own] = set()
            return False, {own}, {own}
        built = [build(x) for x in p.parts]
        if p.kind == "chain":
            empty, begin, end = True, set(), set()
            for e, b, n in built:
                for x in end:
                    follow[x] |= b
                begin |= b if empty else set()
                end = n | (end if e else set())
                empty = empty and e
        else:
            empty, begin, end = any(e for e, _, _ in built), set().union(*(b for _, b, _ in built)), set().union(*(n for _, _, n in built))
            if p.kind == "loop":
                for x in end:
                    follow[x] |= begin
        return empty or p.may_skip, begin, end

    empty, begin, end = build(pattern)
    follow[0] = begin
    moves = [(s, steps[t - 1].label, steps[t - 1].inverse, t) for s, those in sorted(follow.items()) for t in sorted(those)]
    return Automaton(moves, end | ({0} if empty else set()))


def reached(edges: DataFrame, seeds: DataFrame, pattern: Pattern) -> DataFrame:
    """(seed, iri): the nodes to which a path of the pattern leads from seeds(iri); each pair once.

    edges(src_iri, label, dst_iri) may repeat; nulls match nothing. A pattern that may be empty leads each seed to itself. Only the labels of the
    pattern are read, and only around nodes that the frontier holds. Rounds are as many as the longest new path has edges.
    """
    machine = automaton(pattern)
    forward, inverse = ({m[1] for m in machine.moves if m[2] == way} for way in (False, True))
    tables = []
    for labels, way, here, there in ((forward, False, "src_iri", "dst_iri"), (inverse, True, "dst_iri", "src_iri")):
        rows = edges.filter(F.col("label").isin(*labels)) if labels else edges.limit(0)
        tables.append(rows.select(F.col(here).alias("iri"), "label", F.lit(way).alias("inverse"), F.col(there).alias("next")))
    hops = cut(tables[0].unionByName(tables[1]).filter("iri IS NOT NULL AND next IS NOT NULL").distinct(), "hops")
    kind = "array<struct<label:string,inverse:boolean,state:int>>"

    def waiting(state):
        out = F.array().cast(kind)
        for s in {m[0] for m in machine.moves}:
            own = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(way).alias("inverse"), F.lit(t).alias("state")) for a, label, way, t in machine.moves if a == s))
            out = F.when(state == s, own).otherwise(out)
        return out

    newest = cut(seeds.filter("iri IS NOT NULL").select(F.col("iri").alias("seed"), "iri").distinct().withColumn("state", F.lit(0)), "frontier")
    seen, kept = newest, [newest]
    while not newest.isEmpty():
        asks = newest.select("seed", "iri", F.explode(waiting(F.col("state"))).alias("_m")).select("seed", "iri", "_m.*")
        there = asks.join(hops, ["iri", "label", "inverse"]).select("seed", F.col("next").alias("iri"), "state").distinct()
        newest = cut(there.join(seen, ["seed", "iri", "state"], "left_anti"), "frontier")
        kept.append(newest)
        seen = seen.unionByName(newest)
    out = cut(seen.filter(F.col("state").isin(*machine.accepting)).select("seed", "iri").distinct(), "reached")
    drop_scratch(hops, *kept)
    return out

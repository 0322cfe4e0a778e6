"""Shapes: constraints on all nodes of a kind and class, checked together and turned into violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Count:
    """A node has at least `least` and, if given, at most `most` edges of the label."""

    label: str
    least: int = 0
    most: int | None = None

    @property
    def rule(self) -> str:
        return f"{self.label} {self.least}..{'*' if self.most is None else self.most}"


@dataclass(frozen=True)
class Targets:
    """Each edge of the label leads to a node of one of the classes, or of one under them; edges to undefined nodes break this."""

    label: str
    classes: tuple[str, ...]

    @property
    def rule(self) -> str:
        return f"{self.label} to {'|'.join(self.classes)}"


@dataclass(frozen=True)
class Closed:
    """A node has no edges but those of the labels."""

    labels: tuple[str, ...]

    @property
    def rule(self) -> str:
        return f"only {'|'.join(self.labels)}"


@dataclass(frozen=True)
class Has:
    """The column holds a value."""

    column: str

    @property
    def rule(self) -> str:
        return f"{self.column} required"


@dataclass(frozen=True)
class Unique:
    """No other node of the shape in the same source holds the same value; nulls equal nothing."""

    column: str

    @property
    def rule(self) -> str:
        return f"{self.column} unique"


Constraint = Count | Targets | Closed | Has | Unique


@dataclass(frozen=True)
class Shape:
    """Nodes of the kind (any, if null) that are of one of the classes or under one (any or none, if empty)."""

    name: str
    constraints: tuple[Constraint, ...]
    kind: str | None = None
    classes: tuple[str, ...] = ()


def _with_classes(nodes: DataFrame, wanted: Sequence[str], under: DataFrame | None) -> DataFrame:
    """nodes with _in, those of the wanted classes that a node is of or under. The array is never longer than `wanted`."""
    own = F.when(F.col("class_iri").isin(*wanted), F.col("class_iri"))
    if under is None or not wanted:
        return nodes.withColumn("_in", F.array_compact(F.array(own)) if wanted else F.array().cast("array<string>"))
    above = under.filter(F.col("dst_iri").isin(*wanted)).groupBy(F.col("src_iri").alias("class_iri")).agg(F.collect_set("dst_iri").alias("_up"))
    return nodes.join(above, "class_iri", "left").withColumn("_in", F.array_union(F.coalesce("_up", F.array().cast("array<string>")), F.array_compact(F.array(own)))).drop("_up")


def _any_of(classes: Sequence[str]) -> Column:
    return F.arrays_overlap("_in", F.array(*map(F.lit, classes)))


def violations(nodes: DataFrame, edges: DataFrame, shapes: Sequence[Shape], under: DataFrame | None = None) -> DataFrame:
    """(shape, source, kind, iri, rule, found): each rule of a shape that a node of it breaks, once.

    `nodes` has the key (source, kind, iri) and class_iri; `under` holds pairs (src_iri, dst_iri) of classes and those that they lie under, without it
    only a node's own class counts. found is the number of edges of the label (Count), of edges to other targets (Targets), of edges of other labels (Closed,
    edges without a label among them), of nodes that share the value (Unique) and 0 (Has). Repeated node rows are one node, which is of a shape if one of the rows
    is, and has a value if one has; repeated edges count each. Edges from nodes that are not in `nodes` break nothing. Other columns are not read.

    Nodes, edges and the edges with wrong targets are shuffled once by node, counted before the shuffle, for all shapes together: a node with very many edges is one row a task by then.
    Targets costs one more anti-join of the edges of its label, Unique one more count of values; large partitions of these joins are split by adaptive execution.
    """
    names = [s.name for s in shapes]
    if not shapes or len(set(names)) < len(names):
        raise ValueError("shapes need names that differ")
    rules = [(k, c) for k, s in enumerate(shapes) for c in s.constraints]
    targets = list(dict.fromkeys(c for _, c in rules if isinstance(c, Targets)))
    columns = list(dict.fromkeys(c.column for _, c in rules if isinstance(c, (Has, Unique))))
    wanted = sorted({x for s in shapes for x in s.classes} | {x for c in targets for x in c.classes})

    def value(c: str) -> str:
        return f"_v{columns.index(c)}"

    def member(s: Shape) -> Column:
        of_kind = F.lit(True) if s.kind is None else F.col("kind") == s.kind
        return F.coalesce(of_kind & _any_of(s.classes) if s.classes else of_kind, F.lit(False))

    # a column of nodes may have any name, so what is read gets names of its own first
    bare = nodes.select("source", "kind", "iri", "class_iri", *(F.col(f"`{c.replace('`', '``')}`").alias(value(c)) for c in columns))
    known = _with_classes(bare, wanted, under).select("*", *(member(s).alias(f"_s{k}") for k, s in enumerate(shapes)))
    counts: dict[str, Column] = {}
    for j, label in enumerate(dict.fromkeys(c.label for _, c in rules if isinstance(c, Count))):
        counts[label] = F.count_if((F.col("_what") == "edge") & F.col("label").eqNullSafe(label)).alias(f"_n{j}")
    order = list(counts)
    closed = list(dict.fromkeys(c for _, c in rules if isinstance(c, Closed)))

    key = ["source", "kind", "iri"]
    at = edges.select("source", F.col("src_kind").alias("kind"), F.col("src_iri").alias("iri"), "label", "dst_iri")
    facts = known.select(*key, *(f"_s{k}" for k in range(len(shapes))), *map(value, columns), F.lit("node").alias("_what"))
    facts = facts.unionByName(at.select(*key, "label", F.lit("edge").alias("_what")), allowMissingColumns=True)
    if targets:
        right = reduce(DataFrame.unionByName, (known.filter(_any_of(c.classes)).select(F.col("iri").alias("dst_iri"), F.lit(j).alias("_t")) for j, c in enumerate(targets))).distinct()
        tested = reduce(DataFrame.unionByName, (at.filter(F.col("label") == c.label).select(*key, "dst_iri", F.lit(j).alias("_t")) for j, c in enumerate(targets)))
        wrong = tested.join(right, ["_t", "dst_iri"], "left_anti")
        facts = facts.unionByName(wrong.select(*key, "_t", F.lit("wrong").alias("_what")), allowMissingColumns=True)
    seen = facts.groupBy(*key).agg(
        *(F.max(f"_s{k}").alias(f"_s{k}") for k in range(len(shapes))),
        *(F.count(value(c)).alias(value(c)) for c in columns),
        *counts.values(),
        *(F.count_if((F.col("_what") == "edge") & ~F.coalesce(F.col("label").isin(*c.labels), F.lit(False))).alias(f"_c{j}") for j, c in enumerate(closed)),
        *(F.count_if((F.col("_what") == "wrong") & (F.col("_t") == j)).alias(f"_t{j}") for j in range(len(targets))),
    )

    def broken(c: Constraint) -> tuple[Column, Column]:
        if isinstance(c, Count):
            n = F.col(f"_n{order.index(c.label)}")
            return (n < c.least) | (F.lit(False) if c.most is None else n > c.most), n
        if isinstance(c, Has):
            return F.col(value(c.column)) == 0, F.lit(0).cast("long")
        n = F.col(f"_t{targets.index(c)}" if isinstance(c, Targets) else f"_c{closed.index(c)}")
        return n > 0, n

    tests = []
    for k, c in rules:
        if not isinstance(c, Unique):
            bad, found = broken(c)
            tests.append(F.when(F.coalesce(F.col(f"_s{k}"), F.lit(False)) & bad, F.struct(F.lit(names[k]).alias("shape"), F.lit(c.rule).alias("rule"), found.alias("found"))))
    parts = []
    if tests:
        parts.append(seen.select(*key, F.explode(F.array_compact(F.array(*tests))).alias("_b")).select("_b.shape", *key, "_b.rule", "_b.found"))
    for k, c in rules:
        if isinstance(c, Unique):
            own = known.filter(F.col(f"_s{k}") & F.col(value(c.column)).isNotNull()).select(*key, F.col(value(c.column)).alias("_v")).distinct()
            shared = own.groupBy(F.col("source").alias("_from"), F.col("_v").alias("_same")).agg(F.count("*").alias("found")).filter("found > 1")
            met = own.join(shared, F.col("source").eqNullSafe(F.col("_from")) & (F.col("_v") == F.col("_same")))
            parts.append(met.groupBy(*key).agg(F.max("found").alias("found")).select(F.lit(names[k]).alias("shape"), *key, F.lit(c.rule).alias("rule"), "found"))
    empty = known.sparkSession.createDataFrame([], "shape string, source string, kind string, iri string, rule string, found long")
    return reduce(DataFrame.unionByName, parts) if parts else empty

"""Ontology graphs as tables.

nodes(source, kind, iri, id, name, class_iri, ...) has the key (source, kind, iri), as one IRI may name both a class and an
entity; edges(source, src_kind, src_iri, label, dst_iri, seq); prefixes(source, prefix, base). Identifiers are
compared as full IRIs, never as prefixed text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS = "array<struct<label string, to string>>"


def expand(curie: Column, base: Column) -> Column:
    """prefix:local as base + local where a base is known."""
    return F.when(base.isNotNull(), F.concat(base, F.substring(curie, F.instr(curie, F.lit(":")) + 1, F.length(curie)))).otherwise(curie)


def to_iri(rows: DataFrame, column: str, prefixes: DataFrame, out: str) -> DataFrame:
    """rows with `out`, the IRI of the prefixed identifier in `column`, by the prefixes of the row's source."""
    known = prefixes.select(F.col("source"), F.col("prefix").alias("_prefix"), F.col("base").alias("_base"))
    keyed = rows.withColumn("_prefix", F.when(F.contains(column, F.lit(":")), F.split_part(column, F.lit(":"), F.lit(1))))
    return keyed.join(known, ["source", "_prefix"], "left").withColumn(out, expand(F.col(column), F.col("_base"))).drop("_prefix", "_base")


def flatten(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The edges of nodes(source, kind, iri, relations); nodes without relations give none."""
    edges = nodes.select("source", F.col("kind").alias("src_kind"), F.col("iri").alias("src_iri"), F.posexplode("relations").alias("seq", "_r"))
    edges = edges.select("source", "src_kind", "src_iri", F.col("_r.label").alias("label"), F.col("_r.to").alias("_to"), "seq")
    return to_iri(edges, "_to", prefixes, "dst_iri").select("source", "src_kind", "src_iri", "label", "dst_iri", "seq")


def targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the name of their target; targets defined nowhere keep their edge with a null name."""
    named = nodes.select(F.col("iri").alias("dst_iri"), F.col("kind").alias("dst_kind"), F.col("name").alias("dst_name"))
    return edges.join(named, "dst_iri", "left")


def label_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count("*").alias("n"))


def class_counts(nodes: DataFrame) -> DataFrame:
    """Entities of each class, whose IRI is the `class_iri` field, never part of an id."""
    return nodes.filter("kind = 'entity'").groupBy("class_iri").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """iri, out_degree, in_degree of every end of an edge."""
    ends = edges.select(F.col("src_iri").alias("iri"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst_iri").alias("iri"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("iri").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def roots(nodes: DataFrame, edges: DataFrame, label: str = "is_a") -> DataFrame:
    """Nodes from which no edge of the label leads on."""
    return nodes.join(edges.filter(F.col("label") == label).select(F.col("src_iri").alias("iri")), "iri", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame, label: str = "is_a") -> DataFrame:
    """Nodes to which no edge of the label leads."""
    return nodes.join(edges.filter(F.col("label") == label).select(F.col("dst_iri").alias("iri")), "iri", "left_anti")


def closure(edges: DataFrame, label: str | None = "is_a") -> DataFrame:
    """(src_iri, dst_iri, depth): every node with all that it reaches, at the least number of steps.

    Each round doubles the reach: pairs of just 2^k steps meet the pairs of up to 2^k that begin where they end, and pairs known before fall out. So
    there are as many rounds as the depth has binary digits, a pair of a tree is made once, and cycles end. A node that lies on a cycle reaches itself. A node
    that many lead to makes one side of its join long; adaptive execution splits that side. Lineage is cut each round. Nulls lead nowhere.
    """
    from weftwork.operators.rounds import cut

    step = edges if label is None else edges.filter(F.col("label") == label)
    known = cut(step.filter("src_iri IS NOT NULL AND dst_iri IS NOT NULL").select("src_iri", "dst_iri", F.lit(1).alias("depth")).distinct(), "closure")
    reach = 1
    while True:
        far = known.filter(F.col("depth") == reach).select("src_iri", F.col("dst_iri").alias("mid"))
        on = far.join(known.select(F.col("src_iri").alias("mid"), "dst_iri", "depth"), "mid").groupBy("src_iri", "dst_iri").agg((F.min("depth") + reach).alias("depth"))
        newest = cut(on.join(known, ["src_iri", "dst_iri"], "left_anti"), "closure")
        if newest.isEmpty():
            return known
        known = known.unionByName(newest)
        reach *= 2


def depths(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each node with the length of its longest shortest path upward; roots have 0."""
    longest = pairs.groupBy(F.col("src_iri").alias("iri")).agg(F.max("depth").alias("depth"))
    return nodes.select("iri").distinct().join(longest, "iri", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def inferred_types(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(iri, type_iri, depth): an entity's class at depth 0 and all that the class descends from."""
    own = nodes.filter("kind = 'entity' AND class_iri IS NOT NULL").select("iri", F.col("class_iri").alias("type_iri"))
    above = own.join(pairs.select(F.col("src_iri").alias("type_iri"), F.col("dst_iri").alias("_up"), "depth"), "type_iri").select("iri", F.col("_up").alias("type_iri"), "depth")
    return own.withColumn("depth", F.lit(0)).unionByName(above)


def schema_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How often entities of one class point by a label at entities of another."""
    entities = nodes.filter("kind = 'entity'")
    at = edges.filter("src_kind = 'entity'").join(entities.select(F.col("iri").alias("src_iri"), F.col("class_iri").alias("domain_iri")), "src_iri")
    to = at.join(entities.select(F.col("iri").alias("dst_iri"), F.col("class_iri").alias("range_iri")), "dst_iri")
    return to.groupBy("domain_iri", "label", "range_iri").agg(F.count("*").alias("n"))


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("iri").alias("dst_iri")), "dst_iri", "left_anti")


def collisions(nodes: DataFrame) -> DataFrame:
    """IRIs that name nodes of several kinds in one source."""
    return nodes.groupBy("source", "iri").agg(F.countDistinct("kind").alias("kinds")).filter("kinds > 1").select("source", "iri")


def completeness(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per kind: the number of nodes and, for each column, how many have a value."""
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"), *(F.count(c).alias(f"with_{c}") for c in columns))


def title_mismatches(nodes: DataFrame) -> DataFrame:
    """Nodes whose display title is not `name (id: ID)`, then `Definition: ...` and `Examples: ...` where they have such, white space aside."""
    def flat(c: Column) -> Column:
        return F.regexp_replace(c, "(?U)\\s+", "")

    told = F.concat(F.coalesce("name", F.lit("")), F.lit(" (id: "), F.coalesce("id", F.lit("")), F.lit(")"), F.coalesce(F.concat(F.lit("Definition:"), "definition"), F.lit("")), F.coalesce(F.concat(F.lit("Examples:"), "example"), F.lit("")))
    return nodes.filter(F.col("title").isNotNull() & (flat(F.col("title")) != flat(told)))


def group_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind", "group").agg(F.count("*").alias("n"))


def match(triples: DataFrame, patterns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern over triples(s, p, o): terms that start with ? are variables.

    Each pattern is one join on the variables that it shares with those before it; it must share one.
    """
    bound: DataFrame | None = None
    for pattern in patterns:
        rows, names = triples, {}
        for column, term in zip("spo", pattern, strict=True):
            if not term.startswith("?"):
                rows = rows.filter(F.col(column) == term)
            elif term in names:
                rows = rows.filter(F.col(column) == F.col(names[term]))
            else:
                names[term] = column
        rows = rows.select(*(F.col(c).alias(t[1:]) for t, c in names.items()))
        if bound is None:
            bound = rows
            continue
        shared = [c for c in rows.columns if c in bound.columns]
        if not shared:
            raise ValueError(f"pattern {pattern} shares no variable with those before it")
        bound = bound.join(rows, shared)
    if bound is None:
        raise ValueError("no pattern")
    return bound


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(iri, hop): what lies within `hops` edges, in either direction, of seeds(iri)."""
    both = edges.select(F.col("src_iri").alias("a"), F.col("dst_iri").alias("b")).unionByName(edges.select(F.col("dst_iri").alias("a"), F.col("src_iri").alias("b")))
    from weftwork.operators.rounds import cut

    seen = newest = cut(seeds.select("iri").distinct().withColumn("hop", F.lit(0)), "hop")
    for hop in range(1, hops + 1):
        near = newest.join(both, F.col("iri") == F.col("a")).select(F.col("b").alias("iri")).distinct()
        newest = cut(near.join(seen, "iri", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen = seen.unionByName(newest)
    return seen


def age_overlaps(phases: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of age ranges low to high, both ends included, that overlap: (name, other). Ranges with a null bound, or with low over high, overlap nothing.

    Ranges are classed by the power of two that their length stays under. A pair meets in buckets as wide as the class of its longer range, of which either
    touches two at most, and is reported in the one where the later range starts; so a range makes two rows for each longer class that there is, 64 at most,
    however long it is, no pair comes twice and there is no cross join.
    """
    def classed(df: DataFrame) -> DataFrame:
        return df.filter("low <= high").withColumn("_class", F.ceil(F.log2(F.col("high") - F.col("low") + F.lit(1.0))).cast("int"))

    a, b = classed(phases.select("name", "low", "high")), classed(others.select(F.col("name").alias("other"), "low", "high"))
    present = sorted(r[0] for r in a.select("_class").unionByName(b.select("_class")).distinct().collect())
    levels = F.array(*map(F.lit, present)) if present else F.array().cast("array<int>")

    def spread(df: DataFrame) -> DataFrame:
        at = df.withColumn("_level", F.explode(F.filter(levels, lambda x: x >= F.col("_class")))).withColumn("_width", F.pow(F.lit(2.0), F.col("_level")))
        ends = F.array_distinct(F.array(F.floor(F.col("low") / F.col("_width")), F.floor(F.col("high") / F.col("_width"))))
        return at.withColumn("_b", F.explode(ends))

    met = spread(a).join(spread(b).drop("_width").withColumnsRenamed({"low": "low2", "high": "high2", "_class": "_class2"}), ["_level", "_b"])
    kept = met.filter("low <= high2 AND low2 <= high AND _level = greatest(_class, _class2)")
    return kept.filter(F.col("_b") == F.floor(F.greatest("low", "low2") / F.col("_width"))).select("name", "other")

"""Ontology documents in YAML, with an explicit schema: one text at hand, or a folder of files that tasks read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.ontology import RELATIONS, expand, flatten, to_iri
from weftwork.operators.rounds import cut

FIELDS = f"kind string, id string, name string, class string, definition string, example string, description string, relations {RELATIONS}, color string, `group` string, title string, x double, y double"
NODE = f"source string, {FIELDS}"
TEXTS = ("id", "name", "class", "definition", "example", "description")


def repair(text: str) -> tuple[str, int]:
    """Quotes the values of the prefix block that end in a colon, which YAML does not allow bare; with their number."""
    head, mark, tail = text.partition("\nprefixes:")
    fixed, n = re.subn(r"(?m)^(\s+[\w.-]+:\s+)([^\s'\"][^\n]*:)[ \t]*$", r'\1"\2"', tail)
    return head + mark + fixed, n


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def parse(text: str) -> tuple[dict[str, str], list[dict[str, Any]], int]:
    """(prefixes, nodes, repaired values) of a document; missing keys are null, numbers and dates in places of texts become texts."""
    import yaml

    fixed, repaired = repair(text)
    doc = yaml.load(fixed, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
    nodes = []
    for kind, key in (("class", "classes"), ("entity", "entities")):
        for n in doc.get(key) or []:
            style = n.get("style") or {}
            relations = None if n.get("relations") is None else [{"label": _text(r.get("label")), "to": _text(r.get("to"))} for r in n["relations"]]
            place = {c: None if style.get(c) is None else float(style[c]) for c in ("x", "y")}
            nodes.append({"kind": kind, **{c: _text(n.get(c)) for c in TEXTS}, "relations": relations, **{c: _text(style.get(c)) for c in ("color", "group", "title")}, **place})
    prefixes = {str(k): str(v) for k, v in (doc.get("prefixes") or {}).items() if v is not None}
    return prefixes, nodes, repaired


def read_ontology(spark: SparkSession, text: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(nodes, edges, prefixes, repaired values) of one text that the driver holds."""
    known, parsed, repaired = parse(text)
    prefixes = spark.createDataFrame([(source, k, v) for k, v in known.items()], "source string, prefix string, base string")
    nodes = to_iri(spark.createDataFrame([{"source": source, **n} for n in parsed], NODE), "id", prefixes, "iri")
    nodes = to_iri(nodes, "class", prefixes, "class_iri")
    return nodes, flatten(nodes, prefixes), prefixes, repaired


class Ontologies(NamedTuple):
    """nodes and edges as in operators.ontology; prefixes(source, prefix, base); documents(source, repaired, error)."""

    nodes: DataFrame
    edges: DataFrame
    prefixes: DataFrame
    documents: DataFrame


_RELATION = pa.struct([("label", pa.string()), ("to", pa.string())])
_NODE = pa.struct([("kind", pa.string()), *((c, pa.string()) for c in TEXTS), ("relations", pa.list_(_RELATION)), *((c, pa.string()) for c in ("color", "group", "title")), ("x", pa.float64()), ("y", pa.float64())])
_DOCUMENT = pa.schema([("source", pa.string()), ("repaired", pa.int32()), ("error", pa.string()), ("prefixes", pa.map_(pa.string(), pa.string())), ("nodes", pa.list_(_NODE))])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, text in zip(batch["source"].to_pylist(), batch["text"].to_pylist(), strict=True):
            row: dict[str, Any] = {"source": source, "repaired": 0, "error": None, "prefixes": [], "nodes": []}
            try:
                prefixes, row["nodes"], row["repaired"] = parse(text)
                row["prefixes"] = list(prefixes.items())
            except Exception as e:  # noqa: BLE001  a faulty document is data here
                row["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([row], schema=_DOCUMENT)


def read_ontologies(spark: SparkSession, path: str) -> Ontologies:
    """The documents of a folder (or of a pattern of paths), each read and parsed once, by tasks; the driver reads none.

    Spark's own file source hands the files out, small ones together, from any file system that it knows. A source is the file's name. Identifiers are
    expanded by the prefixes of their own document, which stand in its row, so no join is needed. A document that is no valid YAML, or has another shape, gives no nodes, and its error stands in
    `documents`; Spark passes over files without a byte. A document is held whole by one task.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    parsed = files.mapInArrow(_parsed, f"source string, repaired int, error string, prefixes map<string,string>, nodes array<struct<{FIELDS}>>")
    docs = cut(parsed, "ontologies")

    def iri(name: Column) -> Column:
        return expand(name, F.when(F.contains(name, F.lit(":")), F.element_at("prefixes", F.split_part(name, F.lit(":"), F.lit(1)))))

    each = docs.select("source", "prefixes", F.explode("nodes").alias("_n")).select("source", "prefixes", "_n.*")
    nodes = each.withColumn("iri", iri(F.col("id"))).withColumn("class_iri", iri(F.col("class")))
    edges = nodes.select("source", F.col("kind").alias("src_kind"), F.col("iri").alias("src_iri"), "prefixes", F.posexplode("relations").alias("seq", "_r"))
    edges = edges.select("source", "src_kind", "src_iri", F.col("_r.label").alias("label"), iri(F.col("_r.to")).alias("dst_iri"), "seq")
    prefixes = docs.select("source", F.explode("prefixes").alias("prefix", "base"))
    return Ontologies(nodes.drop("prefixes"), edges, prefixes, docs.select("source", "repaired", "error"))

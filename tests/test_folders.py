import os

import pytest
from pyspark.sql import functions as F

from weftwork.sources import ledger, ontology_yaml, page_files


def held(path):
    return {p.name: p.read_text() for p in path.iterdir()}


def test_pages_under_their_names(spark, tmp_path):
    out = tmp_path / "docs"
    rows = [("b", "one", "1"), ("a", "old", "1"), ("a", "new", "2"), ("a", "none", None), ("n", None, "9"), ("../x", "out", "1"), (None, "t", "1"), ("", "t", "1"), ("y" * 300, "t", "1"), ("é", "", "")]
    pages = spark.createDataFrame([(s, m, n, 1, 2) for s, m, n in rows], "slug string, markdown string, name string, text int, pages int")
    report = page_files.write_page_files(pages, str(out))
    assert held(out) == {"a.md": "new\n", "b.md": "one\n", "é.md": "\n"}
    assert {(r.slug, r.pages, r.reason) for r in report.collect()} == {("a", 3, "clash"), ("../x", 1, "unfit"), (None, 1, "unfit"), ("", 1, "unfit"), ("y" * 300, 1, "unfit")}
    page_files.write_page_files(pages.filter("slug = 'b'"), f"file://{out}", ending=".txt")
    assert held(out) == {"b.txt": "one\n"}
    page_files.write_page_files(pages.filter("false"), str(out))
    assert held(out) == {} and os.listdir(tmp_path) == ["docs"]


def test_a_failing_task_leaves_the_folder_as_it_was(spark, tmp_path):
    out = tmp_path / "docs"
    spark.dataSource.register(page_files.PageFiles)

    def write(rows):
        rows.write.format("page_files").mode("overwrite").save(str(out))

    write(spark.createDataFrame([("a", "kept")], "name string, text string"))
    fails = spark.range(20, numPartitions=4).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 18, F.raise_error(F.lit("half way"))).otherwise("x").cast("string").alias("text"))
    with pytest.raises(Exception, match="half way"):
        write(fails)
    assert held(out) == {"a.md": "kept"} and os.listdir(tmp_path) == ["docs"]
    with pytest.raises(Exception, match="overwrite"):
        fails.write.format("page_files").mode("append").save(str(out))


def test_nothing_is_sent_twice(spark, tmp_path):
    log, book = tmp_path / "log", str(tmp_path / "ledger")
    log.mkdir()

    def make(fail_at=-1):
        def sender(row, name):
            if row.k == fail_at:
                return 500
            with open(log / str(row.k), "a") as f:
                f.write(name + "\n")
            return 200

        return lambda: sender

    rows = spark.range(40).select(F.col("id").alias("k"), F.lit("v").alias("row"), F.lit(0).alias("id"))
    with pytest.raises(Exception, match="500"):
        ledger.send_once(rows, ["k"], make(7), book, block=4)
    ledger.send_once(rows.unionByName(rows), ["k"], make(), book, block=4)
    ledger.send_once(rows.filter("k < 10"), ["k"], make(), book, block=3)
    assert {p.name: len(p.read_text().split()) for p in log.iterdir()} == {str(k): 1 for k in range(40)}
    assert ledger.sent(spark, book).count() == 40
    ledger.send_once(rows.filter("false"), ["k"], make(), book)
    nulls = spark.createDataFrame([(None,), (None,)], "k long")
    ledger.send_once(nulls, ["k"], make(), book)
    assert ledger.sent(spark, book).count() == 41


def test_a_block_that_failed_goes_on_where_it_was(spark, tmp_path):
    """Tried again in the same run, as Spark does with a failed task: the rows before the fault are in the ledger."""
    log, book = tmp_path / "log", str(tmp_path / "ledger")

    def send(row, name):
        with open(log, "a") as f:
            f.write(f"{row.k}\n")
        return 200 if len(log.read_text().split()) != 3 else 500

    rows = spark.range(6).select(F.col("id").alias("k")).coalesce(1)
    with pytest.raises(Exception, match="500"):
        ledger.send_once(rows, ["k"], lambda: send, book)
    ledger.send_once(rows, ["k"], lambda: send, book)
    told = log.read_text().split()
    assert len(told) == 7 and len(set(told)) == 6  # only the row that was refused is told again


def test_folder_of_ontologies(spark, tmp_path):
    for k in range(1000):
        (tmp_path / f"d{k}.yaml").write_text(f"prefixes:\n  a: http://x/{k}/\nclasses:\n  - id: a:C\n    name: {k}\n    relations:\n      - {{label: is_a, to: 'a:D'}}\n      - {{label: is_a, to: 'z:E'}}\n")
    (tmp_path / "empty.yaml").write_text("")  # passed over
    (tmp_path / "broken.yaml").write_text("classes: [")
    (tmp_path / "list.yaml").write_text("- 1\n- 2\n")
    (tmp_path / "colon.yaml").write_text("title: t\nprefixes:\n  b: http://x/b:\nentities:\n  - id: b:1\n    class: b:K\n    style: {x: 1, color: red}\n  - name: none\n")
    nodes, edges, prefixes, documents = ontology_yaml.read_ontologies(spark, str(tmp_path))
    assert documents.count() == 1003 and {r.source for r in documents.filter("error IS NOT NULL").collect()} == {"broken.yaml", "list.yaml"}
    assert {(r.source, r.repaired) for r in documents.filter("repaired > 0").collect()} == {("colon.yaml", 1)}
    assert nodes.count() == 1002 and edges.count() == 2000 and prefixes.count() == 1001
    assert {(r.src_iri, r.dst_iri, r.seq) for r in edges.filter("source = 'd7.yaml'").collect()} == {("http://x/7/C", "http://x/7/D", 0), ("http://x/7/C", "z:E", 1)}
    got = {(r.iri, r.class_iri, r.x, r.color, r.name) for r in nodes.filter("source = 'colon.yaml'").collect()}
    assert got == {("http://x/b:1", "http://x/b:K", 1.0, "red", None), (None, None, None, None, "none")}
    one = ontology_yaml.read_ontology(spark, (tmp_path / "d7.yaml").read_text(), "d7.yaml")
    assert sorted(map(tuple, one[0].select(*nodes.columns).collect())) == sorted(map(tuple, nodes.filter("source = 'd7.yaml'").collect()))

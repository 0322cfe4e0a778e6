from pyspark.sql import functions as F

from weftwork.operators import wiki
from weftwork.sources import files, remote, sinks


def test_landed_pages_to_files_and_back(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "Main_Page.txt").write_text("* a\n* b")
    (tmp_path / "raw" / "Other.txt").write_text("x")
    pages = files.landed_pages(spark, str(tmp_path / "raw"))
    kept = files.existing(files.key_list(spark, ["Main_Page", "Missing"]), pages)
    assert [r.name for r in kept.collect()] == ["Main_Page"]
    sinks.write_pages(wiki.wiki_to_markdown(pages), str(tmp_path / "out"))
    back = {r.slug: r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()}
    assert back["main-page"].endswith("\n- a\n- b\n") and set(back) == {"main-page", "other"}
    assert {r.slug for r in files.listing(spark, str(tmp_path / "raw"), ".txt").collect()} == {"Main_Page", "Other"}


def test_front_matter(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("---\nsidebar_position: 2\ntitle: A title\n---\nbody\n---\nmore")
    (tmp_path / "b.md").write_text("no block")
    got = {r.path.rpartition("/")[2]: r for r in files.front_matter_pages(spark, str(tmp_path)).collect()}
    assert (got["a.md"].position, got["a.md"].title, got["a.md"].description, got["a.md"].body) == (2, "A title", None, "body\n---\nmore")
    assert got["b.md"].position is None and got["b.md"].body == "no block"


def test_first_item(spark):
    rows = spark.createDataFrame([('{"items":[{"title":"t"},{"title":"u"}]}',), ('{"items":[]}',), ("{}",)], "raw string")
    assert [r.t for r in rows.select(files.first_item(F.col("raw"), "struct<title string>")["title"].alias("t")).collect()] == ["t", None, None]


def test_remote_calls_isolate_faults(spark):
    def flaky():
        def client(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("down")
            return [(200, t.upper()) for t in texts]

        return client

    rows = spark.createDataFrame([("a",), ("bad",)], "request string").repartition(2, "request")
    got = {r.request: (r.status, r.body, r.error) for r in remote.call(rows, flaky).collect()}
    assert got["bad"][2] == "down" and (got["a"][1] == "A" or got["a"][2] == "down")
    assert {r.body for r in remote.call(rows, lambda: remote.constant_client("hi")).collect()} == {"hi"}


def test_snapshot_replaces(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.snapshot(spark.range(3), path)
    sinks.snapshot(spark.range(1), path)
    assert spark.read.json(path).count() == 1
    sinks.send(spark.range(2), lambda: lambda row: 200)

"""Every registered query of the base library against its SQL, and the entry without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from weftwork.plans import queries as plans

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_without_training_data(tmp_path):
    shutil.copytree(ROOT / "weftwork", tmp_path / "weftwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(plans.QUERIES)

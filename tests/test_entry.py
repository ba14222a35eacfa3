"""Each query against its SQL, as the driver compares them; and the library without its optional subpackage."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import placemill.queries as library

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, small, duck, name):
    df = library.queries()[name](spark, small)
    got = rows(df.columns, df.collect())
    sql = library.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())


def test_entry(spark, small):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "email" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dedupe_counts(spark, small):
    found = library.queries()["dedupe_hits"](spark, small)
    assert found.filter("kept").count() == 702


def test_library_stands_alone(tmp_path):
    """Without the subpackage and the pipeline, the entry point and all else still import."""
    for part in ("placemill", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / part).is_dir() else shutil.copy)(ROOT / part, tmp_path / part)
    shutil.rmtree(tmp_path / "placemill/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lead_list' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_nothing_imports_the_subpackage():
    for f in (ROOT / "placemill").rglob("*.py"):
        if "llm" not in f.parts:
            assert "placemill.llm" not in f.read_text()

"""Every query runs on the smallest tables and agrees with its SQL."""

import importlib
import os
import subprocess
import sys

import pytest

from penumbra.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are elsewhere")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:19].removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    out = catalogue.queries()[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    made = duck.execute(sql)
    order = [d[0] for d in made.description]
    assert sorted(order) == columns
    want = sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in made.fetchall())
    assert got == want


def test_entry_points_stand_without_the_optional_packages(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for entry in ("__spark_entry__.py", "penumbra"):
        os.symlink(f"{root}/{entry}", tmp_path / entry) if entry.endswith(".py") else None
    os.mkdir(tmp_path / "penumbra")
    for part in os.listdir(f"{root}/penumbra"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{root}/penumbra/{part}", tmp_path / "penumbra" / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry_registers_everything():
    entry = importlib.import_module("__spark_entry__")
    assert set(catalogue.queries()) <= set(entry.queries())

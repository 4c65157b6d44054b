"""The registered queries against their SQL on the smallest tables, and what must hold without the llm folders."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tarn import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in own.SQL:
        assert got
        return
    res = duck.execute(own.SQL[name])
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, map(tuple, got)) == rows_of(columns, want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "tarn"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    package = tmp_path / "tarn"
    package.mkdir()
    for p in (root / "tarn").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr

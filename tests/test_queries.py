"""Every catalogue query against its DuckDB oracle on the smallest tables, values as sorted text."""

import decimal
import glob
import os

import duckdb
import pytest

from catloom.plans import registry

registry.load()
SMALL = "/root/testdata/sf0.001"


def text(v):
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in sorted(cols)) for r in rows)
    want = sorted(tuple(text(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{home}/catloom", tmp_path / "catloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{home}/{name}"):
            shutil.copy(f"{home}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'site_summary' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)

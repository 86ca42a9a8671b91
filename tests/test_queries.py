"""Every query with SQL against DuckDB at the smallest scale, and the entry without the training-data operators."""

import os
import subprocess
import sys

import pytest

from millrace.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def canonical(rows):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr([plain(x) for x in v]) if isinstance(v, (list, tuple)) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)

    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duck.execute(f"select {quoted} from ({registry.ORACLES[name]})").fetchall()
    assert canonical(map(tuple, df.select(*cols).collect())) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()); print('fine')"
    for part in ("__spark_entry__.py", "millrace"):
        os.symlink(f"{root}/{part}", tmp_path / part) if part.endswith(".py") else os.makedirs(tmp_path / part)
    for part in os.listdir(f"{root}/millrace"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{root}/millrace/{part}", tmp_path / "millrace" / part)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(f"{root}/__spark_entry__.py").read())
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert "fine" in done.stdout, done.stderr

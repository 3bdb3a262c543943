import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from leafmill.plans import suite

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_queries_against_sql(spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    for name, sql in suite.SQL.items():
        got = suite.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, want)) == sorted(map(key, got.select(*cols).collect())), name


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_needs_the_training_data_operators():
    code = "import sys; sys.modules['leafmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert int(out) == len(suite.QUERIES)

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestrata.session import session

    tmp = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp}/shared", "spark.sql.warehouse.dir": f"{tmp}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL over the smallest tables, rows as a multiset."""

    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        rel = duck.execute(sql)
        names = [x[0] for x in rel.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())

    return check

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def _plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


@pytest.fixture(scope="session")
def same(spark, sf):
    """Compare a registered query with its SQL."""
    import duckdb

    def compare(run, sql):
        df = run(spark, sf)
        con = duckdb.connect()
        for n in "customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"create view {n} as select * from '{sf}/{n}.parquet'")
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        cols = sorted(df.columns)
        assert cols == sorted(names)
        a = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        b = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
        assert a == b

    return compare

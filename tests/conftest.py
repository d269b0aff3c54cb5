import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from quirelake import ship

    return ship(s)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    assert glob.glob(f"{sf_dir}/*")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


def rows_of_sql(con, sql):
    q = con.sql(sql)
    cols = [d[0] for d in q.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(r[i] for i in order) for r in q.fetchall()], key=repr)


@pytest.fixture(scope="session")
def same():
    def check(df, con, sql):
        assert sorted(df.columns) == sorted(d[0] for d in con.sql(sql).description)
        assert rows_of(df) == rows_of_sql(con, sql)

    return check

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from seqloom.functions.runtime import ship

    ship(session)
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same_rows(df, con, sql):
    """Columns by name and rows in any order."""
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(repr(r[i]) for i in at) for r in cur.fetchall())
    assert got == want

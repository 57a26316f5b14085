import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    made = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    """Rows as sorted tuples with the columns in order of their names."""
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[k]) for k in order) for r in done.fetchall()), key=repr)


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from isobar.session import session

    made = session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__host="127.0.0.1",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def oracle(sql: str, folder: str):
    """The rows of SQL over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con.execute(sql).df()


def as_rows(df):
    """Rows as sorted text, columns by name."""
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return sorted(map(repr, map(tuple, df.values.tolist())))

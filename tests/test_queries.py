"""Every registered query of cubes, series, samples and tracks, against its SQL where
it has some."""

import pytest

from isobar.plans.more_queries import ORACLE_SQL, QUERIES

from .conftest import DATA, as_rows, oracle

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), oracle(ORACLE_SQL[name], FOLDER)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert as_rows(ours) == as_rows(theirs)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_works_without_the_corpus_part():
    import subprocess
    import sys
    import tempfile
    from pathlib import Path
    import shutil

    root = Path(__file__).parent.parent
    with tempfile.TemporaryDirectory() as folder:
        shutil.copy(root / "__spark_entry__.py", folder)
        shutil.copytree(root / "isobar", f"{folder}/isobar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "HOME": folder}, check=True)


def test_every_supplier_has_its_storm(spark):
    got = QUERIES["src6_7_detect_and_stitch"](spark, FOLDER).toPandas()
    keys = {r["s_suppkey"] for r in spark.read.parquet(f"{FOLDER}/supplier.parquet").select("s_suppkey").collect()}
    assert len(keys) > 1 and set(got["s_suppkey"]) == keys
    assert (got.groupby("s_suppkey").size() == 12).all() and (got.groupby("track").size() == 12).all()

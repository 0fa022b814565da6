"""Every query of the library agrees with its SQL; those without SQL give rows."""

import subprocess
import sys
from pathlib import Path

import pytest

from wavemill import catalog


def key(rows):
    return sorted(tuple("null" if v is None else "nan" if v != v else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*cols).collect()]
    quoted = ", ".join(f'"{c}"' for c in cols)
    theirs = duck.execute(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]}) AS z").fetchall()
    assert key(ours) == key(theirs)


SLOW = {"microstate_clusters", "microstate_chain", "microstate_templates", "grid_search", "random_forest", "svm"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_query_without_sql_gives_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_runs_without_the_training_data_package(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    blocked = "import sys; sys.modules['wavemill.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", blocked], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert said == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))]

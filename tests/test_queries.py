"""Every query with SQL gives the rows of its SQL, at the smallest scale."""

import pytest

from quantmill import plans

from .compare import close, connect, rows

QUERIES, SQL = plans.collected()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small_dir, con, name):
    df = QUERIES[name](spark, small_dir)
    found = rows(df.columns, df.collect())
    rel = con.sql(SQL[name])
    expected = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(found) == len(expected) and len(found) > 0
    for a, b in zip(found, expected, strict=True):
        assert all(map(close, a, b)), (a, b)


def test_entry_imports_without_the_training_data_package():
    import subprocess
    import sys

    from .conftest import ROOT

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'meta_label' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_sql_has_queries():
    assert SQL.keys() <= QUERIES.keys() and len(QUERIES) > 120

"""The driver's contract, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(frame):
    frame = frame[sorted(frame.columns)].copy()
    for name in frame:
        frame[name] = frame[name].map(lambda v: "null" if v is None or (isinstance(v, float) and np.isnan(v)) else repr(round(float(v), 9)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v))
    return sorted(map(tuple, frame.values))


def names():
    from wordloom.plans import catalog

    return sorted(catalog.ORACLES)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    from wordloom.plans import catalog

    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


def test_registry_is_whole():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_entry_works_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['wordloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_flagship_is_capped_nested_and_disjoint(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["q_safe_replacements"](spark, str(DATA)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert rows
    for mine in by.values():
        spans = sorted((r.start, r.stop) for r in mine)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        for key in ("text", "sentence"):
            counts = {}
            for r in mine:
                counts[r[key]] = counts.get(r[key], 0) + 1
            assert max(counts.values()) <= 2

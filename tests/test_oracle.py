"""Every query that has SQL against DuckDB over the same tables."""

import os

import duckdb
import pytest

from tessera import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table[c].to_pylist() for c in names], strict=True)))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_is_its_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toArrow()
    want = duck.sql(plans.ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - {"lsa", "cross_validated_probe", "few_shot_probe", "clustering_scores"}))
def test_query_without_sql_has_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry_module_needs_no_optional_part(sf):
    """Without the training-data subpackage the module imports and lists the rest."""
    import subprocess
    import sys

    code = "import sys; sys.modules.update({'tessera.llm': None, 'tessera.llm.queries': None}); import __spark_entry__ as e; q = e.queries(); assert 'sentence_split_counts' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert found.returncode == 0 and int(found.stdout.split()[-1]) == len(plans.QUERIES), found.stderr

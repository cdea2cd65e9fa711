"""Every query with SQL on the smallest tables against DuckDB, and the others for rows."""

import pytest

from edgeloom import queries_benchmarks, queries_edges, queries_graph, queries_mapping, queries_models, queries_references, queries_samples, queries_sources, queries_tasks

MODULES = [queries_references, queries_edges, queries_graph, queries_mapping, queries_models, queries_tasks, queries_benchmarks, queries_sources, queries_samples]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLE = {n: o for m in MODULES for n, o in m.ORACLE.items()}
SLOW = {"svm_link", "logistic_link", "node2vec", "spectral"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, check_oracle):
    check_oracle(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_without_sql(name, spark, small):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry_point(spark, small):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() == 3

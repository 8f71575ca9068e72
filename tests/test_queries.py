"""Every registered query against its SQL; those without SQL run and are tested by value elsewhere."""

import pytest
from compare import check, connect

from tracemill.plans import compare_queries, domain_queries, evaluation_queries, lookup_queries, metric_queries, ordered_queries, registry, report_queries, source_queries, state_queries, stream_queries, text_queries  # noqa: F401


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    if name in registry.ORACLES:
        check(df, registry.ORACLES[name], con)
    else:
        assert len(set(df.columns)) == len(df.columns)
        assert df.count() > 0


def test_entry_without_subpackage(spark, data):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["chain_collapse", "passk_by_task", "interval_merge", "asof_pair", "state_diff"])
def test_partitioning_does_not_matter(spark, data, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, registry.QUERIES[name](spark, data).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]

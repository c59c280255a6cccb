import os

import pytest

from riskloom.plans.queries import ORACLE, QUERIES
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def one_partition(spark):
    """The tables are small: one partition a shuffle keeps the many jobs short."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        same(df, ORACLE[name], SF)
    else:
        assert df.count() >= 0


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLE) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())

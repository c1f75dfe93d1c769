"""Every core query against its SQL; the others run and give rows."""

import pytest
from compare import DATA, connect, rows

from mentionmill.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        r = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in r.description]
        assert got == rows(names, r.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 10
    assert set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

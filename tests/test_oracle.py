"""Every core query with SQL gives the rows of DuckDB."""

import pytest

from sparkprep import plans

from .compare import duck, rows

SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, con, name):
    got = plans.queries()[name](spark, data).toPandas()
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["normalize_messages", "document_chunks", "mix_order", "crop_preserving_answer", "tensor_role_classify", "causal_attention"])
def test_plans_stay_in_the_jvm(spark, data, name):
    plan = plans.queries()[name](spark, data)._jdf.queryExecution().toString()
    for bad in ("Python", "Arrow", "CartesianProduct"):
        assert bad not in plan

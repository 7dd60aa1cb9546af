"""Queries of the corpus operators next to their SQL, on the two small tables."""

import pytest

from oracle import canonical, connect

from lorebase.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = QUERIES[name](spark, sf_dir)
    result = connect(sf_dir).execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = canonical(columns, result.fetchall())
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert len(found) == len(wanted) > 0
    assert [x for x in zip(found, wanted) if x[0] != x[1]][:3] == []

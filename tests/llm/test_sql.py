"""The DuckDB SQL of the operators against their queries on a small table."""

import duckdb
import pytest

from linkrisk.llm import queries
from tests.llm.conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    want = {r[0]: dict(zip(columns, r)) for r in cur.fetchall()}
    got = rows(getattr(queries, name)(spark, SF))
    assert got and len(got) == len(want) and set(got[0]) == set(columns)
    for r in got:
        w = want[r[columns[0]]]
        assert {k: v for k, v in r.items() if k != "score"} == {k: v for k, v in w.items() if k != "score"}
        assert r.get("score", 0) == pytest.approx(w.get("score", 0), abs=1e-12)

"""Every registered query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toArrow()
    con.register("got", got)
    cols = ", ".join(sorted(got.column_names))
    want = f"(SELECT {cols} FROM ({queries.ORACLE[name]}))"
    assert con.execute(f"SELECT count(*) FROM ((SELECT {cols} FROM got) EXCEPT ALL {want})").fetchall() == [(0,)]
    assert con.execute(f"SELECT count(*) FROM ({want} EXCEPT ALL SELECT {cols} FROM got)").fetchall() == [(0,)]

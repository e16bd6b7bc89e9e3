"""Queries against their SQL where codes of six digits repeat, as they do from a million products on."""

import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("repeated")
    shift = "CASE i WHEN 0 THEN {0} WHEN 1 THEN 100000 + {0} ELSE 1000000 + {0} END AS {0}"
    for name in os.listdir(SMALL):
        if name not in ("part.parquet", "lineitem.parquet"):
            os.symlink(f"{SMALL}/{name}", out / name)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT p.* REPLACE ({shift.format('p_partkey')}, p_size + i AS p_size) FROM '{SMALL}/part.parquet' p, range(3) r(i)) TO '{out}/part.parquet'")
    con.execute(f"COPY (SELECT p.* REPLACE ({shift.format('l_partkey')}) FROM '{SMALL}/lineitem.parquet' p, range(3) r(i)) TO '{out}/lineitem.parquet'")
    return str(out)


@pytest.mark.parametrize("name", ["union_docs", "index_filter", "remap_codes", "exact_status", "code_search", "stream_sync", "stream_vectorize"])
def test_rows_are_those_of_the_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("part", "orders", "customer", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, folder).select(*columns).collect()
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(got) == order(want.fetchall())


def test_words_of_one_id_are_one_document(spark, folder):
    """Rows of one id add their words up; lengths of fields are equal there, so SQL's any_value is one value."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["dictionary_search"])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()["dictionary_search"](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_quick_search_where_lengths_agree(spark, folder, tmp_path):
    """With one status for all products the lengths of one id agree, and the rows are those of the SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_size // 10 * 10 + 5 AS p_size) FROM '{folder}/part.parquet') TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["quick_search"])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()["quick_search"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())

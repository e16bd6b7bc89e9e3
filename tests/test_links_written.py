"""How links are written out: dealt over tasks, in an order in which files hold little of them twice."""

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tesserae.operators import linking


def _tables(spark, n=30_000, copies=200):
    p = spark.range(n).selectExpr("concat('P', lpad(cast(id as string), 6, '0')) AS product_id", "concat('name ', id % 3, '.') AS product_name")
    texts = spark.range(copies * 4).selectExpr("id AS row_id", "concat('text with P00000', id % 2, CASE WHEN id % 4 = 0 THEN concat(' and name ', id % 3, '.') ELSE '' END) AS text")
    return texts, p


def _size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet"))


def test_links_of_names_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linking, "_LINKS_AT_ONCE", 200_000, raising=False)
    texts, p = _tables(spark)
    linking.name_mentions(texts, p).write.parquet(f"{tmp_path}/out")
    rows = sorted(pq.read_metadata(f).num_rows for f in glob.glob(f"{tmp_path}/out/*.parquet"))
    assert sum(rows) == 200 * 10_000 and rows[-1] < 2_000_000 / 2
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.groupBy("row_id").agg(F.countDistinct("product_id").alias("n")).where("n <> 10000").count() == 0


def test_equal_lists_of_ids_follow_one_another(spark, tmp_path):
    texts, p = _tables(spark)
    out = linking.link_products(texts, p, r"(?U)\bP\d{6}\b")
    out.select("row_id", F.array_join("product_ids", ",").alias("ids")).write.parquet(f"{tmp_path}/out")
    # three lists of 80 KB and 200 texts with one: 16 MB where each is written, as it was
    assert _size(f"{tmp_path}/out") < 4_000_000
    # rows with the most ids come first in each file, where a writer learns how long rows are
    for f in glob.glob(f"{tmp_path}/out/*.parquet"):
        sizes = [len(t) for t in pq.read_table(f).column("ids").to_pylist()]
        assert sizes == sorted(sizes, reverse=True)
    got = {r["row_id"]: r["n"] for r in out.select("row_id", F.size("product_ids").alias("n")).collect()}
    assert len(got) == 800 and got[1] == 1 and got[4] in (10_000, 10_001)


def test_sets_that_do_not_come_again_are_made_of_their_names(spark):
    p = spark.createDataFrame([(f"P{i:03d}", "ab" if i % 2 else "cd") for i in range(40)], "product_id string, product_name string")
    texts = spark.createDataFrame([(i, f"P{i:03d} " + ["ab", "cd", "", "ab cd"][i % 4]) for i in range(40)], "row_id int, text string")
    got = {r["row_id"]: (r["_ids"], r["_related"]) for r in linking.with_links(texts, texts, p).collect()}
    for i in range(40):
        want = sorted({f"P{i:03d}"} | {f"P{j:03d}" for j in range(40) if ("ab" if j % 2 else "cd") in ["ab", "cd", "", "ab cd"][i % 4].split()})
        assert got[i] == (want, ", ".join(f"{w}({'ab' if int(w[1:]) % 2 else 'cd'})" for w in want))

import random
from datetime import datetime

from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.sources import dumps, numbering, store, tables

DUMP = """-- a comment; with a semicolon
/* another; one */
CREATE TABLE t (a int);
INSERT INTO `product_master_a` (product_id, product_name, price) VALUES
('P001', 'it''s; a "name"', 12.50),
('P002', 'back\\'slash -- kept', NULL), ('P003', 'a (b), c', 'bad');
UPDATE t SET a = ';' # tail
WHERE b = 1;
select 1"""


def test_statements():
    got = list(dumps.split_statements(DUMP))
    assert [k for k, _ in got] == ["CREATE", "INSERT", "UPDATE", "OTHER"]
    table, columns, rows = dumps.split_tuples(got[1][1])
    assert table == "product_master_a" and columns == ["product_id", "product_name", "price"]
    assert rows == [["P001", "it's; a \"name\"", "12.50"], ["P002", "back'slash -- kept", None], ["P003", "a (b), c", "bad"]]
    assert dumps.split_tuples("SELECT 1") is None and list(dumps.split_statements("")) == []
    assert dumps.split_tuples("INSERT INTO t VALUES (now(), (1+2), '')")[2] == [["now()", "(1+2)", ""]]


def test_dump_to_rows(spark, tmp_path):
    (tmp_path / "a.sql").write_text(DUMP)
    (tmp_path / "b.sql").write_text("INSERT INTO u VALUES " + ",".join(f"({i})" for i in range(2500)) + ";")
    statements = dumps.read_sql_dump(spark, str(tmp_path))
    rows = dumps.insert_rows(statements)
    typed = {r["product_id"]: r for r in dumps.typed_rows(rows.where("file = 'a.sql'"), schemas.PRODUCTS, ["product_id", "product_name", "price"]).collect()}
    assert typed["P001"]["ok"] and float(typed["P001"]["price"]) == 12.5 and not typed["P003"]["ok"] and typed["P003"]["price"] is None and typed["P002"]["ok"]
    b = rows.where("file = 'b.sql'").agg(F.max("tuple_no"), F.max("batch_no"), F.count("*")).first()
    assert tuple(b) == (2500, 2, 2500)
    files = dumps.list_files(spark, str(tmp_path))
    ledger = files.where("file = 'a.sql'").select("file", "hash", F.current_timestamp().alias("processed_at"))
    assert [r["file"] for r in dumps.new_files(files, ledger).collect()] == ["b.sql"]


def test_outcome(spark):
    rows = [("a", True)] * 11 + [("a", False)] + [("b", True)] * 10 + [("b", False)] + [("c", False)] + [("d", True)]
    got = {r["file"]: r["success"] for r in dumps.import_outcome(spark.createDataFrame(rows, "file string, ok boolean")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}


def test_upsert_is_idempotent_and_partial_update_keeps_the_rest(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], "_id string, v string, updated_at int")
    new = spark.createDataFrame([("2", "x", 1), ("2", "y", 2), ("3", "z", 1)], "_id string, v string, updated_at int")
    once = store.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("1", "a", 1), ("2", "y", 2), ("3", "z", 1)] == sorted(map(tuple, store.upsert(once, new).collect()))
    patch = spark.createDataFrame([("1", "q"), ("2", None), ("9", "r")], "_id string, v string")
    assert sorted(r["v"] for r in store.partial_update(once, patch, ["_id"], ["v"]).collect()) == ["q", "y", "z"]


def test_incremental_in_two_steps_equals_full(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("last_modified"))
    assert tables.incremental_extract(df, None).count() == 100
    mark, key = datetime(1970, 1, 1, 0, 0, 10), 31
    rest = tables.incremental_extract(df, mark, key="id", last_key=key)
    assert rest.count() == 100 - 32 and tables.incremental_extract(df, mark).count() == 100 - 33
    pages = tables.page_rows(df, "last_modified", "id", 7)
    assert {r["page_no"]: r["n"] for r in pages.groupBy("page_no").agg(F.count("*").alias("n")).collect()} == {**{i: 7 for i in range(14)}, 14: 2}
    assert [r["id"] for r in tables.page(df, "last_modified", "id", 2, 7).collect()] == sorted(r["id"] for r in pages.where("page_no = 2").collect())


def test_written_documents_are_read_by_index(spark, tmp_path):
    from tesserae.operators.search import index_filter

    docs = spark.createDataFrame([("1", "erp-products"), ("2", "erp-warehouse"), ("3", "other")], "_id string, _index string")
    store.write_docs(docs, str(tmp_path / "s"))
    read = index_filter(spark.read.parquet(str(tmp_path / "s")), "erp-*")
    assert read.count() == 2 and "PartitionFilters: [isnotnull(_index" in read._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_rows_that_share_one_time(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.when(F.col("id") % 9 > 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(F.timestamp_seconds(F.col("id"))).alias("ts"), (F.col("id") * 7919 % 5003).alias("key"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (None, 2)], rows.schema))
    got = numbering.number_in_order(rows, [F.col("ts"), F.col("key")], "n", per_part=300)
    of = {(r["ts"], r["key"]): r["n"] for r in got.collect()}
    order = sorted(of, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert [of[k] for k in order] == list(range(1, 5003))
    assert numbering.number_in_order(rows.limit(0), [F.col("ts")], "n").count() == 0
    paged = tables.page_rows(rows, "ts", "key", 100)
    assert {r["page_no"]: r["count"] for r in paged.groupBy("page_no").count().collect()} == {p: 100 if p < 50 else 2 for p in range(51)}


def test_partial_update_with_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    patch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 0), (2, None, 1)], "k int, v string, at int")
    got = store.partial_update(docs, patch, ["k"], ["v"], ("at",)).collect()
    assert sorted(map(tuple, got)) == [(1, "y"), (2, "b"), (3, "c")]


BUSINESS = """INSERT INTO product_master_a (product_id, product_name, product_model, category, price, stock_qty, manufacture_date, supplier, status) VALUES
('P001', '感測器甲', 'S-1', '感測器', 1200.50, 40, '2024-11-02', '甲公司', '正常'), ('P012', '馬達乙', 'M-2', '馬達', 860.00, 3, '2024-12-01', '乙公司', '缺貨'),
('P016', '測距儀', 'L-9', '量測', 5400.00, 60, '2025-01-05', '甲公司', '正常'), ('P020', '閥門', 'V-4', '氣動', 15.25, 500, '2024-10-10', '丙公司', '停產');
INSERT INTO product_warehouse_b (product_id, product_name, warehouse_location, quantity, last_inventory_date, manager, special_notes, min_stock_level) VALUES
('P016', '測距儀', '北 倉', 25, '2025-01-30', '林', '防震；同區 P020、P016', 10), ('P016', '測距儀', '南倉', 40, '2025-01-31', '陳', '定期校正', 15),
('P012', '', '南倉', NULL, '2025-01-19', '陳', NULL, 15), ('P001', '感測器甲', '北 倉', 45, '2025-01-20', '林', '避光', 20);
"""
COMPLAINTS = """INSERT INTO customer_complaint_c (complaint_id, complaint_date, customer_name, customer_company, complaint_type, severity, description, handler, status, resolution_date) VALUES
('CC01', '2025-02-01', '王', '大同', '品質', '高', '訂購P012 以外：P001、P016、P020；三項都有問題', '李', '處理中', NULL),
('CC02', '2025-02-02', '吳', '東方', '交期', '中', '序號 P012-001 至 P012-005 異常，P0121 與 XP001 無關', '李', '已解決', '2025-02-09'),
('CC03', '2025-02-03', '周', NULL, '服務', '低', 'P999 沒有資料', '張', '處理中', NULL);
"""


def test_business_dumps_become_documents(spark, tmp_path):
    """Dumps of the three tables, read as rows, linked and made into documents."""
    from tesserae.operators import documents, facets, linking

    (tmp_path / "a.sql").write_text(BUSINESS)
    (tmp_path / "b.sql").write_text(COMPLAINTS)
    rows, read = dumps.insert_rows(dumps.read_sql_dump(spark, str(tmp_path))), {}
    for name, schema in (("product_master_a", schemas.PRODUCTS), ("product_warehouse_b", schemas.WAREHOUSE), ("customer_complaint_c", schemas.COMPLAINTS)):
        mine = rows.where(F.col("table") == name)
        read[name] = dumps.typed_rows(mine, schema, mine.first()["columns"])
        assert read[name].where("not ok").count() == 0
    p, w, c = (read[n] for n in ("product_master_a", "product_warehouse_b", "customer_complaint_c"))
    assert [r["product_id"] for r in linking.orphan_rows(p, w).collect()] == ["P020"] and linking.orphan_rows(w, p).count() == 0
    made = documents.union_docs(documents.product_docs(p), documents.warehouse_docs(w, p), documents.complaint_docs(c, p))
    docs = {r["_id"]: r for r in made.collect()}
    assert len(docs) == 4 + 4 + 3
    ids = {k: r["product_ids"] for k, r in docs.items()}
    assert ids["warehouse_P016_北_倉"] == ["P016", "P020"] and ids["warehouse_P016_南倉"] == ["P016"] and ids["warehouse_P012_南倉"] == ["P012"]
    assert ids["complaint_CC01"] == ["P001", "P016", "P020"] and ids["complaint_CC02"] == ["P012"] and ids["complaint_CC03"] == []
    assert docs["warehouse_P012_南倉"]["title"] == "[P012] 馬達乙 @ 南倉" and docs["warehouse_P012_南倉"]["metadata"]["quantity"] == "0"
    assert docs["complaint_CC01"]["metadata"]["related_products"] == "P001(感測器甲), P016(測距儀), P020(閥門)" and docs["product_P020"]["metadata"]["price"] == "15.25"
    facet = facets.product_facet(made.withColumn("query_id", F.lit(1))).collect()
    assert {r["value"]: r["count"] for r in facet} == {"P001": 3, "P012": 3, "P016": 4, "P020": 3}


def test_dumps_in_many_chunks_equal_one_text(spark, tmp_path):
    rng = random.Random(21)
    bits = ["INSERT INTO t VALUES (1)", ";", "; ", "\n", "'a;b'", "'it''s'", "'x\\'y;'", '"q;\n"', "`c;``d`", "-- note; '\n", "# other; \"\n", "/* b; ' */", "--x", " ", "\n\n", "UPDATE t", "'long\n;\n'", "/*\n;\n*/", "\u00e9\u6f22", "\r\n"]
    want = set()
    for k in range(12):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))
        (tmp_path / f"f{k}.sql").write_bytes(text.encode())
        want |= {(f"f{k}.sql", i, kind, sql) for i, (kind, sql) in enumerate(dumps.split_statements(text))}
    big = "INSERT INTO t VALUES ('" + "line;\n" * 400 + "');\nselect 1"
    (tmp_path / "big.sql").write_text(big)
    want |= {("big.sql", i, kind, sql) for i, (kind, sql) in enumerate(dumps.split_statements(big))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "70b", "333b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [tuple(r) for r in dumps.read_sql_dump(spark, str(tmp_path)).collect()]
            assert set(got) == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_table_by_jdbc(spark, tmp_path):
    """Through the database that comes with Spark: whole, by predicates, and by ranges of a column."""
    jdbc = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "dbtable": "PRODUCTS", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(50).select(F.col("id").alias("K"), (F.col("id") * 3).alias("V"))
    rows.write.format("jdbc").options(**jdbc).save()
    want = sorted(map(tuple, rows.collect()))
    for got in (
        tables.read_table(spark, jdbc=jdbc),
        tables.read_table(spark, jdbc=jdbc, predicates=["K < 20", "K >= 20"]),
        tables.read_table(spark, jdbc=jdbc | {"partitionColumn": "K", "lowerBound": "0", "upperBound": "50", "numPartitions": "4"}),
    ):
        assert sorted(map(tuple, got.collect())) == want
    assert tables.read_table(spark, jdbc=jdbc, predicates=["K < 20", "K >= 20"]).rdd.getNumPartitions() == 2


def test_file_hash_is_the_same_however_spark_cuts(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    with open(path, "w") as f:
        f.writelines(f"line {i} é\n" for i in range(2000))
    found = set()
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size in ("128m", "7k", "1k"):
            for n in names:
                spark.conf.set(n, size)
            found |= {r["hash"] for r in dumps.file_hashes(spark, path).collect()}
        with open(path, "a") as f:
            f.write("more\n")
        other = {r["hash"] for r in dumps.file_hashes(spark, path).collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(found) == 1 and len(other) == 1 and not found & other


def test_few_lines_are_lexed_at_once():
    import pandas as pd

    batches = [pd.DataFrame({"path": "a", "block": [0] * 700 + [1] * 300, "value": [str(i) for i in range(1000)]}), pd.DataFrame({"path": "a", "block": [1] * 5, "value": ["x"] * 5})]
    got = [(first["block"], text.count("\n"), begins) for first, text, begins in dumps._chunks(iter(batches))]
    assert got == [(0, 256, True), (0, 256, False), (0, 188, False), (1, 256, True), (1, 44, False), (1, 5, False)]


def test_links_by_name_are_stored_once(spark, tmp_path, monkeypatch):
    """A hundred products of one name and sixty texts with it: the store holds the names, and reading it gives whole documents."""
    from collections import Counter

    from tesserae.plans import queries

    d = tmp_path / "in"
    for t in ("supplier", "lineitem", "customer", "part", "orders"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "part":
            df = df.withColumn("p_name", F.when(F.col("p_partkey") < 100, F.lit("blue box")).otherwise(F.col("p_name")))
        (df.where("o_orderkey < 240") if t == "orders" else df.where("l_orderkey < 300") if t == "lineitem" else df).write.parquet(str(d / f"{t}.parquet"))
    monkeypatch.setattr(queries, "shared_dir", lambda _: str(tmp_path / "shared"))
    got = {r["_index"]: r["docs"] for r in queries.QUERIES["write_docs"](spark, str(d)).collect()}
    path = next((tmp_path / "shared").glob("*-store"))
    held = spark.read.parquet(str(path / "documents" if (path / "documents").exists() else path)).where("type = 'complaint'")
    whole = queries.all_docs(spark, str(d))
    links = lambda df: df.agg(F.sum(F.size("product_ids"))).first()[0]
    assert links(held) <= 3 * got["erp-complaints"] < links(whole.where("type = 'complaint'")) / 4
    rows = lambda df: Counter(str((*r[:-1], sorted(r[-1].items()))) for r in df.select(*[c for c in whole.columns if c != "metadata"], "metadata").collect())
    assert rows(store.read_linked_docs(spark, str(path))) == rows(whole)


def test_large_statements_are_few_python_objects_at_once():
    """Of an Arrow batch of 2,000 texts of 20,000 characters, 40 MB, only a few are taken out and handed on at a time."""
    import tracemalloc

    import pyarrow as pa
    import pytest

    body = "it''s; " * 2857
    want = body.replace("''", "'")
    texts = [f"-- a; b\nINSERT INTO `t` (id, body) VALUES ({i}, '{body}'), ({i}, NULL); /* end; */" for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(2000)]), pa.array(texts)], ["file", "value"])
    del texts
    runs = []

    class Frame:
        """What of a DataFrame the operator asks, to get at the function that runs in the workers."""

        def select(self, *_):
            return self

        where = select

        def mapInArrow(self, run, schema):
            runs.append(run)

    if not hasattr(dumps, "text_rows"):
        pytest.fail("statements and tuples are cut from whole batches of Python strings")
    dumps.text_rows(Frame())
    tracemalloc.start()
    n = 0
    for got in runs[0](iter([batch])):
        assert got.nbytes < 4_000_000
        for file, no, at, part, values in zip(*[got.column(c).to_pylist() for c in ("file", "stmt_no", "tuple_no", "batch_no", "values")]):
            assert (file, no, at, part, values) == (str(n // 2), 0, n % 2 + 1, 0, [str(n // 2), None if n % 2 else want])
            n += 1
    assert n == 4000 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()

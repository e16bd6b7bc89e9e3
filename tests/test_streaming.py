from datetime import datetime

from pyspark.sql import functions as F

from tesserae.operators import vectors
from tesserae.schemas import DOCUMENT
from tesserae.streaming import jobs, keyed

SCHEMA = ", ".join(f"{k} {v}" for k, v in DOCUMENT.items())


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def docs(spark, rows):
    base = spark.createDataFrame(rows, "_id string, all_content string, updated_at timestamp")
    return base.select(*[F.col(c) if c in base.columns else F.lit(None).cast(t).alias(c) for c, t in DOCUMENT.items()])


def test_sync_then_vectors(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    t = lambda n: datetime(2024, 1, n)
    docs(spark, [("1", "a b", t(1)), ("2", "c", t(1)), ("1", "newer", t(2))]).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    sync = lambda: run(jobs.stream_sync(stream(), lambda df: df, target, str(tmp_path / "c1")))
    embed = lambda n: run(jobs.stream_vectorize(stream(), target, SCHEMA, vectors.hashing_encoder(4), "2024-02-01 00:00:00", str(tmp_path / f"c2{n}")))
    sync()
    now = {r["_id"]: r for r in jobs.read_latest(spark, target, SCHEMA).collect()}
    assert len(now) == 2 and now["1"]["all_content"] == "newer" and now["1"]["content_vector"] is None
    embed(1)
    now = {r["_id"]: r for r in jobs.read_latest(spark, target, SCHEMA).collect()}
    assert len(now["1"]["content_vector"]) == 4 and now["1"]["all_content"] == "newer"
    # a later change replaces the row and its vector
    docs(spark, [("2", "changed", t(3))]).write.mode("append").parquet(source)
    sync()
    now = {r["_id"]: r for r in jobs.read_latest(spark, target, SCHEMA).collect()}
    assert now["2"]["all_content"] == "changed" and now["2"]["content_vector"] is None and now["1"]["content_vector"] is not None


def test_sliding_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("table"), F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = jobs.stream_recent_changes(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), delay="3650 days")
    out = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c"))
    run(out)
    want = jobs.stream_recent_changes(events)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_file_drop_and_late_rows(spark, tmp_path):
    source = tmp_path / "sql"
    source.mkdir()
    (source / "a.sql").write_text("INSERT INTO t VALUES (1); INSERT INTO t VALUES (2);")
    (source / "skip.txt").write_text("INSERT INTO t VALUES (3);")
    seen = []
    run(jobs.stream_file_drop(spark, str(source), lambda df, n: seen.extend(tuple(r) for r in df.select("file", "stmt_no", "stmt_type").collect()), str(tmp_path / "c")))
    assert seen == [("a.sql", 0, "INSERT"), ("a.sql", 1, "INSERT")]
    df = spark.createDataFrame([(1, datetime(2024, 1, 1))] * 2 + [(2, datetime(2024, 1, 1))], "k int, ts timestamp")
    assert jobs.late_rows(df, "k", "ts").count() == 2


def test_file_drop_with_ledger(spark, tmp_path):
    source, ledger = tmp_path / "sql", str(tmp_path / "ledger")
    source.mkdir()
    seen = []

    def load(df, n):
        rows = df.collect()
        seen.extend((r["file"], r["sql"]) for r in rows)
        return spark.createDataFrame([(r["file"], "bad" not in r["sql"]) for r in rows], "file string, ok boolean")

    def drop(name, text, checkpoint):
        (source / name).write_text(text)
        run(jobs.stream_file_drop(spark, str(source), load, str(tmp_path / checkpoint), ledger=ledger))

    drop("a.sql", "INSERT INTO t VALUES (1);", "c1")
    drop("b.sql", "INSERT INTO t VALUES ('bad');", "c1")
    drop("c.sql", "INSERT INTO t VALUES (2);", "c2")  # a new checkpoint is offered all files again, as a batch 0 of its own
    assert sorted(seen) == [("a.sql", "INSERT INTO t VALUES (1)"), ("b.sql", "INSERT INTO t VALUES ('bad')"), ("c.sql", "INSERT INTO t VALUES (2)")]
    drop("b.sql", "INSERT INTO t VALUES (3);", "c3")
    assert seen[-1] == ("b.sql", "INSERT INTO t VALUES (3)")
    found = [(r["file"], r["success"]) for r in jobs.read_ledger(spark, ledger).collect()]
    assert sorted(found) == [("a.sql", True), ("b.sql", False), ("b.sql", True), ("c.sql", True)]


def test_late_rows_in_a_stream(spark, tmp_path):
    """Repeats of a change are left out, within a batch and across batches."""
    source = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    t = lambda m: datetime(2024, 1, 1, 0, m)
    stream = lambda: jobs.late_rows(spark.readStream.schema("k int, ts timestamp").parquet(source), "k", "ts")
    out = lambda: run(stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
    rows((1, t(0)), (1, t(0)), (2, t(1)))
    out()
    rows((1, t(0)), (2, t(5)), (3, t(6)))
    out()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, t(0)), (2, t(1)), (2, t(5)), (3, t(6))]


def test_latest_change_by_keyed_state(spark, tmp_path):
    """Late and repeated changes give the batch upsert; a failed text is tried again without a change of its own."""
    source, flag = tmp_path / "changes", str(tmp_path / "works")
    spark.conf.set(*keyed.PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with timers there would always be one more
    try:
        schema = "_id string, updated_at timestamp, text string"

        def encode(texts):
            import os

            if texts[0].startswith("hard") and not os.path.exists(flag):
                raise ValueError("not now")
            return [[float(len(t))] for t in texts]

        got = []

        def turn(rows):
            spark.createDataFrame([(k, t and f"2024-01-01 00:00:{t:02d}", x) for k, t, x in rows], "_id string, t string, text string").selectExpr("_id", "cast(t as timestamp) updated_at", "text").coalesce(1).write.mode("append").parquet(str(source))
            out = keyed.stream_latest(spark.readStream.schema(schema).parquet(str(source)), encode, wait=1)
            write = lambda df, n: got.extend(df.collect())
            out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

        turn([("a", 5, "five"), ("a", 3, "three"), ("b", 1, "hard one"), ("a", 5, "five"), (None, 1, "x"), ("e", 1, None)])
        assert {(r["_id"], r["text"], r["content_vector"] is None) for r in got} == {("a", "five", False), ("b", "hard one", True), ("e", "", True)}
        got.clear()
        open(flag, "w").close()
        turn([("a", 4, "late"), ("a", 5, "five"), ("c", 2, "new")])
        assert {(r["_id"], r["text"], tuple(r["content_vector"])) for r in got} == {("b", "hard one", (8.0,)), ("c", "new", (3.0,))}
        got.clear()
        turn([("b", 9, "other"), ("a", 6, "six")])
        assert {(r["_id"], r["text"], r["tries"]) for r in got} == {("b", "other", 1), ("a", "six", 1)}
    finally:
        spark.conf.unset(keyed.PROVIDER[0])
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_registered_streams_leave_the_session_as_it_was(spark):
    """The keyed-state query needs settings of its own and gives back those of the session."""
    from tesserae.plans import streams

    keys = (keyed.PROVIDER[0], "spark.sql.streaming.noDataMicroBatches.enabled")
    before = [spark.conf.get(k, None) for k in keys]
    got = {r["doc_id"]: r["vector"] for r in streams.stream_latest(spark, "/root/testdata/sf0.001").collect()}
    assert [spark.conf.get(k, None) for k in keys] == before
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == {str(r["doc_id"]): ",".join(str(r["text"].count(v)) for v in "aeiou") if r["text"] else None for r in docs}

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tesserae.functions import columns as fn
from tesserae.operators.documents import embedding_text


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


def test_strings(spark):
    v = F.col("v")
    assert one(spark, fn.normalize_keyword(v), "ÉTÉ Ok") == "ete ok"
    assert one(spark, fn.ignore_above(v, 3), "abcd") is None
    assert one(spark, fn.preview(v, 3), "<b>abcdef</b>") == "abc..." and one(spark, fn.preview(v, 3), None) == ""
    assert one(spark, fn.em_to_mark(v), "a <em>b</em>") == "a <mark>b</mark>"
    assert one(spark, fn.clean_text(v), "a\r\n​b﻿\x01c\td 漢") == "a\nbc\td 漢"
    assert one(spark, fn.join_truthy(v, F.lit(""), F.lit(None), F.lit("y"))) == "x y"
    assert one(spark, fn.convert_script(v, [("简", "簡"), ("体", "體")]), "简体") == "簡體"
    docs = spark.range(1).withColumn("all_content", F.lit("z" * 9000))
    assert docs.select(embedding_text(docs)).first()[0] == "z" * 8000


def test_price_and_times(spark):
    df = spark.createDataFrame([(Decimal("12500.00"),), (Decimal("150000000.50"),), (Decimal("1.25"),), (None,)], "p decimal(12,2)")
    assert [r[0] for r in df.select(fn.shown_price(F.col("p"))).collect()] == ["12500.0", "150000000.5", "1.25", "None"]
    times = ["2024-01-02T03:04:05Z", "1704164645000", "2024-01-02 03:04:05", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(fn.parse_time(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5)] * 3 + [None, None]


def test_maps_and_decoding(spark):
    m = F.create_map(F.lit("id"), F.lit("1"), F.lit("field_b"), F.lit("x" * 60), F.lit("field_a"), F.lit("y"), F.lit("status"), F.lit("old"))
    got = one(spark, fn.with_defaults(m, {"id": F.lit("2"), "title": F.lit("t")}, {"status": F.lit("new")}))
    assert got["id"] == "1" and got["title"] == "t" and got["status"] == "new"
    assert one(spark, fn.field_pairs(m, 2)) == "field_a: y\nfield_b: " + "x" * 50
    raw = [("漢字".encode(), "漢字"), ("漢字".encode("cp950"), "漢字"), (b"\xff\xfe" + "漢".encode("utf-16le"), "﻿漢"), (None, None)]
    df = spark.createDataFrame([(r, w) for r, w in raw], "r binary, w string")
    assert all(r[0] == r[1] for r in df.select(fn.decode("r"), "w").collect())

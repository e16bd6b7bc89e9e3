"""Tables in generations: bucketed by key in a shared folder, appended to, never rewritten until compacted.

Each batch is a generation of its own, known by a row in the list of commits, which is written last: what a
failed batch left is not read, and a batch that was committed is not taken twice. Reading by key and joining by
key need no exchange of the table.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.scratch import shared_dir


def default_buckets(spark: SparkSession) -> int:
    return max(1, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tesserae-{uuid.uuid4().hex}-{name}"


class Generations:
    """Rows of ``schema`` in ``path``; a folder that a former session wrote, with as many buckets, is opened as it is."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int | None = None):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.buckets = buckets or default_buckets(spark)
        self.name = f"tesserae_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        whole = T.StructType([*schema.fields, T.StructField("_gen", T.LongType())])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{path}/rows'")

    def commits(self) -> dict[str, int]:
        """Batch -> generation, one entry a batch."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return {}
        return {r["batch"]: r["gen"] for r in self.spark.read.schema("batch string, gen long").parquet(f"{self.path}/commits").collect()}

    def append(self, rows: DataFrame, gen: int, placed: bool = False) -> None:
        """Write rows of a generation that is to be committed; ``placed``: they are partitioned by key as the buckets are."""
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], F.lit(gen).cast("long").alias("_gen"))
        placed_rows = rows if placed else rows.repartition(self.buckets, self.key)
        placed_rows.write.format("parquet").mode("append").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/rows").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def commit(self, batch: str, gen: int) -> None:
        self.spark.createDataFrame([(batch, gen)], "batch string, gen long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def new_generation(self) -> int:
        return max(time.time_ns(), 1 + max(self.commits().values(), default=0))

    def read(self) -> DataFrame:
        """The rows of all committed generations, with ``_gen``."""
        return self.spark.table(self.name).where(F.col("_gen").isin(list(self.commits().values())))


class DocStore:
    """Documents by key: upserts and deletes are appended, the latest row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "_id", buckets: int | None = None):
        self.key, self.columns = key, schema.names
        self.table = Generations(spark, path, T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType())]), key, buckets)

    def apply(self, batch: str, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """A batch of changed rows, at most one a key, and of keys that go; a key in both goes. A committed batch is not taken again."""
        if batch in self.table.commits():
            return
        gen = self.table.new_generation()
        if deleted is not None:
            gone = deleted.select(self.key).distinct()
            if changed is not None:
                changed = changed.join(gone, self.key, "left_anti")
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema if f.name not in (self.key, "_gone")]
            self.table.append(gone.select(self.key, *rest, F.lit(True).alias("_gone")), gen)
        if changed is not None:
            self.table.append(changed.select(*self.columns, F.lit(False).alias("_gone")), gen)
        self.table.commit(batch, gen)

    def read(self) -> DataFrame:
        """One row a key. The window is over the buckets as they lie; nothing is shuffled."""
        w = Window.partitionBy(self.key).orderBy(F.col("_gen").desc())
        latest = self.table.read().withColumn("_turn", F.row_number().over(w)).where("_turn = 1 and not _gone")
        return latest.select(*self.columns)

    def compacted(self, path: str) -> DocStore:
        """The same documents in another folder as one generation."""
        schema = T.StructType([f for f in self.table.schema if f.name != "_gone"])
        out = DocStore(self.table.spark, path, schema, self.key, self.table.buckets)
        out.apply("compacted", self.read())
        return out

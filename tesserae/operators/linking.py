"""Finding product codes and names in texts, and joining texts to products."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.scratch import save

CODE = r"(?U)\bP\d{3}\b"


def code_mentions(texts: DataFrame, products: DataFrame, pattern: str = CODE, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, product_id): distinct known codes in each text. Word boundaries count letters of all scripts."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("product_id"))
    return valid_ids(found, products)


def valid_ids(found: DataFrame, products: DataFrame) -> DataFrame:
    return found.join(products.select("product_id"), "product_id", "left_semi").select(*found.columns)


_automata: dict[str, object] = {}


def automaton(token: str, names: list[str]):
    """The Aho-Corasick automaton of ``names``; a worker keeps the last one, known by ``token``."""
    if token not in _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for i, n in enumerate(names):
            built.add_word(n, i)
        built.make_automaton()
        _automata.clear()
        _automata[token] = built
    return _automata[token]


def _found(token: str, names):
    """(key, text) -> (key, name) for each distinct name in the text, in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = pa.array(names.value, pa.string()), automaton(token, names.value)
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                some = sorted({n for _, n in found.iter(text)}) if len(known) else []  # an automaton of no names can't be asked
                rows += [i] * len(some)
                hits += some
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), known.take(pa.array(hits, pa.int64()))], ["_key", "name"])

    return run


def named_texts(texts: DataFrame, products: DataFrame, key: str = "row_id", text: str = "text", name: str = "product_name", names_at_once: int = 200_000, characters_at_once: int = 16_000_000) -> DataFrame:
    """(key, names): the sorted distinct product names that stand in each text, case-sensitive; texts without one have no row.

    The distinct names become an Aho-Corasick automaton, so a text is read once for all of them. An automaton is sent to
    the executors, so it has at most ``names_at_once`` names and about ``characters_at_once`` characters; more names are
    dealt into several, each with a pass of its own over the texts. Empty names and texts, and nulls, link nothing.
    """
    spark = texts.sparkSession
    names = products.where(F.length(name) > 0).select(F.col(name).alias("name")).distinct()
    n, size = names.agg(F.count(F.lit(1)), F.sum(F.length("name"))).first()
    shards = max(1, -(-n // names_at_once), -(-(size or 0) // characters_at_once))
    shard = F.pmod(F.xxhash64("name"), F.lit(shards))
    names = names if shards == 1 else save(names.withColumn("_shard", shard), "names")
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length(text) > 0)
    schema = T.StructType([T.StructField("_key", texts.schema[key].dataType), T.StructField("name", T.StringType())])
    parts = []
    for i in range(shards):
        some = sorted(r[0] for r in (names if shards == 1 else names.where(F.col("_shard") == i)).select("name").collect())  # of bounded number and size
        parts.append(rows.mapInArrow(_found(uuid.uuid4().hex, spark.sparkContext.broadcast(some)), schema))
    hit = reduce(lambda a, b: a.unionByName(b), parts)
    return hit.groupBy(F.col("_key").alias(key)).agg(F.array_sort(F.collect_set("name")).alias("names"))


#: Products and texts of one set of names that one row holds, and links that one task writes out, about.
_IDS_AT_ONCE, _TEXTS_AT_ONCE, _LINKS_AT_ONCE = 1_000, 10_000, 20_000_000
#: Sets of names and codes that are sent to all tasks.
_SETS = 50_000


def _ids_of_names(sets: DataFrame, products: DataFrame, name: str, chunks: int = 1) -> DataFrame:
    """(names, _chunk, ids): for each distinct set of names the ids that it links, made once for all texts that share it."""
    sold = products.where(F.length(name) > 0).select(F.col(name).alias("name"), "product_id")
    chunk = F.pmod(F.xxhash64("product_id"), F.lit(chunks))
    each = sets.select("names").distinct().select("names", F.explode("names").alias("name")).join(sold, "name")
    return each.groupBy("names", chunk.alias("_chunk")).agg(F.sort_array(F.collect_set("product_id")).alias("ids"))


def _with_codes(ids: Column, codes: Column) -> Column:
    """Sorted ids and a few codes as one sorted array; it is nearly sorted as it stands."""
    none = F.array().cast("array<string>")
    return F.sort_array(F.concat(F.coalesce(ids, none), F.filter(F.coalesce(codes, none), lambda c: ~F.coalesce(F.array_contains(ids, c), F.lit(False)))))


def _tasks(spark: SparkSession, links: int | None) -> int:
    """How many tasks write out so many links; Spark knows the sizes of what it shuffles, and the links aren't."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(links or 0) // _LINKS_AT_ONCE))


def name_mentions(texts: DataFrame, products: DataFrame, key: str = "row_id", text: str = "text", name: str = "product_name", **limits: int) -> DataFrame:
    """(key, product_id): products whose name stands in the text (``named_texts``); names that several ids share link all.

    A text meets the ids of its set of names some at a time, in order of sets and ids, so the links are only written out, and files
    of them are small however many there are: few texts and ids come again and again in each.
    """
    named = save(named_texts(texts, products, key, text, name, **limits), "named")
    most = products.where(F.length(name) > 0).groupBy(name).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    chunks = max(1, -(-most // _IDS_AT_ONCE))
    ids = save(_ids_of_names(named, products, name, chunks), "ids")
    sets = named.groupBy("names").agg(F.count(F.lit(1)).alias("m")).join(ids.groupBy("names").agg(F.sum(F.size("ids")).alias("n")), "names")
    links, shared = sets.agg(F.sum(F.col("m") * F.col("n")), F.max("m")).first()
    parts = max(1, -(-(shared or 0) // _TEXTS_AT_ONCE))
    each = named.withColumns({"_part": F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), "_chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))})
    some, at = ids.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["names", "_chunk", "_part"]
    met = each.repartition(_tasks(texts.sparkSession, links), *at).join(some.hint("merge"), at)
    return met.select(key, F.explode("ids").alias("product_id"))


def _shown_product() -> Column:
    return F.concat("product_id", F.lit("("), F.coalesce("product_name", F.lit("")), F.lit(")"))


def _found_in(texts: DataFrame, products: DataFrame, pattern: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    part = F.struct(F.col("product_id").alias("id"), _shown_product().alias("part"))
    shown = products.select("product_id", "product_name")
    codes = code_mentions(texts, products, pattern, key, text).join(shown, "product_id").groupBy(key).agg(F.sort_array(F.collect_set("product_id")).alias("_codes"), F.collect_list(part).alias("_parts"))
    return codes, named_texts(texts, products, key, text).withColumnRenamed("names", "_names")


def found_links(rows: DataFrame, texts: DataFrame, products: DataFrame, pattern: str = CODE, key: str = "row_id", text: str = "text") -> DataFrame:
    """``rows`` with what stands in ``texts``: ``_codes``, the known ones, ``_parts``, (id, ``id(name)``) of their products, and ``_names``, the sorted names; null for none."""
    codes, named = _found_in(texts, products, pattern, key, text)
    return rows.join(codes, key, "left").join(named, key, "left")


def spread_links(rows: DataFrame, products: DataFrame, key: str = "row_id", found: DataFrame | None = None, related: bool = True) -> DataFrame:
    """``rows`` of ``found_links`` with ``_ids``, and ``_related``, ``id(name), id(name)`` in order of ids, in place of what was found; null where nothing is linked.

    What a set of names stands for is made once; where sets of names and codes come again, so is what both of them stand for.
    It is joined last, to rows in order of their sets, those with the most ids first: equal lists follow one another, so that files
    hold them once, and a writer that guesses the sizes of rows by those it has seen guesses too much, not too little.
    ``found`` are the columns of what was found, if these are at hand without the rows. ``_parts`` aren't needed without ``related``.
    """
    spark, kept = rows.sparkSession, [c for c in rows.columns if c not in ("_codes", "_parts", "_names")]
    rows = rows if related else rows.withColumn("_parts", F.lit(None).cast("array<struct<id: string, part: string>>"))
    found = rows if found is None else found if related else found.withColumn("_parts", F.lit(None).cast("array<struct<id: string, part: string>>"))
    both = F.to_json(F.struct("_names", "_codes"))
    sets = save(found.where("_names is not null").groupBy(both.alias("_set")).agg(*[F.first(c).alias(c) for c in ("_names", "_codes", "_parts")], F.count(F.lit(1)).alias("_times")), "sets")
    ids = save(_ids_of_names(sets.select(F.col("_names").alias("names")), products, "product_name").select(F.col("names").alias("_names"), F.col("ids").alias("_some")), "ids")
    sized = sets.join(ids.select("_names", F.size("_some").cast("long").alias("_n")), "_names")
    links, once, n_sets = sized.agg(F.sum(F.col("_n") * F.col("_times")), F.sum("_n"), F.count(F.lit(1))).first()
    alike = (links or 0) >= 4 * (once or 0)
    if not alike:  # the sets with their codes are about as many as the rows
        both = F.to_json(F.struct("_names"))
        sized = sized.groupBy(both.alias("_set")).agg(F.first("_names").alias("_names"), F.max("_n").alias("_n"), F.sum("_times").alias("_times"))
    copies = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("_times") / (5 * _LINKS_AT_ONCE))).cast("int")
    sized = sized.withColumns({"_copies": copies, "_order": -F.col("_n")}).drop("_n", "_times")
    if related:
        shown = products.select("product_id", "product_name")
        more = ids.select("_names", F.explode("_some").alias("product_id")).join(shown, "product_id").groupBy("_names").agg(F.sort_array(F.collect_list(_shown_product())).alias("_more"))
        ids = ids.join(more, "_names")
    else:
        ids = ids.withColumn("_more", F.lit(None).cast("array<string>"))

    def written(df: DataFrame) -> DataFrame:
        """``_ids`` and ``_related`` of a set's products and the row's codes."""
        other = F.transform(F.filter("_parts", lambda p: ~F.coalesce(F.array_contains("_some", p["id"]), F.lit(False))), lambda p: p["part"])
        none = F.array().cast("array<string>")
        linked = F.col("_codes").isNotNull() | F.col("_some").isNotNull()
        shown = F.array_join(F.sort_array(F.concat(F.coalesce("_more", none), F.coalesce(other, none))), ", ")
        return df.withColumns({"_ids": F.when(linked, _with_codes(F.col("_some"), F.col("_codes"))), **({"_related": F.when(linked, shown)} if related else {})})

    made = ["_ids", "_related"] if related else ["_ids"]
    values = sized.join(ids, "_names")
    values = written(values) if alike else values
    at, some = ["_order", "_set", "_copy"], made if alike else ["_some", "_more"]
    values = values.select("_order", "_set", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), *some)
    places = sized.select("_set", "_order", "_copies")
    rows = rows.withColumn("_set", F.when(F.col("_names").isNotNull(), both)).join(F.broadcast(places) if n_sets <= _SETS else places, "_set", "left")
    # rows without a name have a set each, so that they don't meet in one task
    rows = rows.withColumns({"_set": F.coalesce("_set", F.concat(F.lit("-"), F.col(key).cast("string"))), "_order": F.coalesce("_order", F.lit(0)), "_copy": F.pmod(F.xxhash64(key), F.coalesce("_copies", F.lit(1))).cast("int")})
    out = rows.repartition(_tasks(spark, links), *at).join(values.hint("merge"), at, "left")
    if not alike:
        return written(out).select(*kept, *made)
    none = F.lit(None).cast("array<string>")
    alone = written(out.withColumnsRenamed({c: f"_set{c}" for c in made}).withColumns({"_some": none, "_more": none}))  # codes without a name
    return alone.select(*kept, *[F.coalesce(f"_set{c}", c).alias(c) for c in made])


def with_links(rows: DataFrame, texts: DataFrame, products: DataFrame, pattern: str = CODE, key: str = "row_id", text: str = "text") -> DataFrame:
    """``rows`` with what ``texts`` link by code or by name: ``_ids`` and ``_related``, as ``spread_links`` has them."""
    codes, named = _found_in(texts, products, pattern, key, text)
    found = save(codes.join(named, key, "full_outer"), "found")
    return spread_links(rows.join(found, key, "left"), products, key, found)


def link_products(texts: DataFrame, products: DataFrame, pattern: str = CODE, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, product_ids): sorted ids found by code or by name; texts without a link have no row."""
    codes = code_mentions(texts, products, pattern, key, text).groupBy(key).agg(F.sort_array(F.collect_set("product_id")).alias("_codes"))
    named = named_texts(texts, products, key, text).withColumnRenamed("names", "_names")
    found = save(codes.join(named, key, "full_outer"), "found")
    return spread_links(found, products, key, found, related=False).withColumnRenamed("_ids", "product_ids")


def own_first(own: str, rest: str):
    """The row's own id, then the others."""
    none = F.array().cast("array<string>")
    return F.array_union(F.when(F.length(own) > 0, F.array(F.col(own))).otherwise(none), F.coalesce(rest, none))


def enrich_from_product(rows: DataFrame, products: DataFrame, columns: list[str]) -> DataFrame:
    """Product columns as ``p_<column>``, null where the product is unknown. Spark picks the join by size."""
    return rows.join(products.select("product_id", *[F.col(c).alias(f"p_{c}") for c in columns]), "product_id", "left")


def related_products(links: DataFrame, products: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, related_products): ``id(name), id(name)`` in order of ids."""
    named = links.select(key, F.explode("product_ids").alias("product_id")).join(products.select("product_id", "product_name"), "product_id")
    return named.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(_shown_product())), ", ").alias("related_products"))


def orphan_rows(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Rows whose product is unknown; with the tables exchanged, products that no row has."""
    return rows.join(products.select("product_id"), "product_id", "left_anti")


def remap_codes(rows: DataFrame, code_map: DataFrame, column: str = "product_id") -> DataFrame:
    """``column`` replaced by ``new_id`` where ``code_map`` (old_id, new_id) has it."""
    joined = rows.join(code_map, F.col(column) == F.col("old_id"), "left").withColumn(column, F.coalesce("new_id", column))
    return joined.drop("old_id", "new_id")

"""Search documents from business rows. Label texts are fixed values of the document format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.columns import date_text, join_truthy, shown, shown_price
from tesserae.operators import linking
from tesserae.schemas import DOCUMENT
from tesserae.sources.scratch import save

#: Ids (eight characters of a note count as one) that are sent to all tasks.
_IDS = 1_000_000


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def dynamic_fields(df: DataFrame, metadata: Column) -> Column:
    """``metadata`` with the ``field_*`` columns of ``df`` that it lacks."""
    extra = [c for c in df.columns if c.startswith("field_")]
    if not extra:
        return metadata
    added = F.map_filter(_map(**{c: F.col(c) for c in extra}), lambda k, v: ~F.map_contains_key(metadata, k))
    return F.map_concat(metadata, added)


def _document(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = DOCUMENT | {c: kind for c, kind in LINKS.items() if c in columns}
    return df.select(*[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def product_docs(products: DataFrame, null_text: str = "None") -> DataFrame:
    c = lambda name: _col(products, name)
    s = lambda name: shown(c(name), null_text)
    key = F.concat(F.lit("product_"), c("product_id"))
    metadata = _map(
        product_name=c("product_name"), product_model=c("product_model"), price=shown_price(c("price"), None), stock_qty=c("stock_qty").cast("int"),
        category=c("category"), supplier=c("supplier"), manufacture_date=date_text(c("manufacture_date")))
    return _document(
        products, _id=key, _index=F.lit("erp-products"), type=F.lit("product_master"), id=c("product_id"), doc_id=key,
        title=F.concat(F.lit("["), c("product_id"), F.lit("] "), s("product_name"), F.lit(" ("), s("product_model"), F.lit(")")),
        content=F.concat(F.lit("型號: "), s("product_model"), F.lit("; 分類: "), s("category"), F.lit("; 供應商: "), s("supplier"), F.lit("; 狀態: "), s("status"), F.lit("; 價格: "), shown_price(c("price"), null_text), F.lit("; 庫存: "), s("stock_qty")),
        all_content=join_truthy(*[c(x) for x in ("product_id", "product_name", "product_model", "category", "supplier", "status")]),
        searchable_content=F.concat(F.lit("產品編號 "), c("product_id"), F.lit(" 產品名稱 "), s("product_name"), F.lit(" 型號 "), s("product_model"), F.lit(" 分類 "), s("category")),
        product_ids=F.array(c("product_id")), status=c("status"), metadata=dynamic_fields(products, metadata), updated_at=c("last_modified"))


def warehouse_docs(warehouse: DataFrame, products: DataFrame, pattern: str = linking.CODE, null_text: str = "None") -> DataFrame:
    """One document per row; ids: the row's own, then those its own notes mention. The table has no key, so links go by the notes.

    The distinct notes are written, as codes and names are each looked for in them; their links are broadcast up to ``_IDS`` ids.
    """
    notes = save(warehouse.select(F.col("special_notes").alias("_notes"), "special_notes").where("special_notes is not null").distinct(), "notes")
    links = save(linking.link_products(notes, products, pattern, "_notes", "special_notes").withColumnRenamed("product_ids", "_ids"), "links")
    few = (links.agg(F.sum(F.size("_ids") + F.length("_notes") / 8)).first()[0] or 0) <= _IDS
    rows = linking.enrich_from_product(warehouse, products, ["product_name"]).join(F.broadcast(links) if few else links, F.col("special_notes") == F.col("_notes"), "left")
    c = lambda name: _col(rows, name)
    s = lambda name: shown(c(name), null_text)
    name = F.coalesce(F.nullif(c("product_name"), F.lit("")), c("p_product_name"), F.lit(""))
    place = F.coalesce(c("warehouse_location"), F.lit(""))
    key = F.concat(F.lit("warehouse_"), c("product_id"), F.lit("_"), F.replace(place, F.lit(" "), F.lit("_")))
    metadata = _map(
        product_id=c("product_id"), product_name=name, warehouse_location=place, quantity=F.coalesce(c("quantity").cast("int"), F.lit(0)),
        min_stock_level=F.coalesce(c("min_stock_level").cast("int"), F.lit(0)), manager=c("manager"), special_notes=c("special_notes"), last_inventory_date=date_text(c("last_inventory_date")))
    return _document(
        rows, _id=key, _index=F.lit("erp-warehouse"), type=F.lit("warehouse"), id=F.concat(c("product_id"), F.lit(":"), place), doc_id=key,
        title=F.concat(F.lit("["), c("product_id"), F.lit("] "), name, F.lit(" @ "), place),
        content=F.concat(F.lit("庫存數量: "), s("quantity"), F.lit("; 最低庫存: "), s("min_stock_level"), F.lit("; 管理人: "), s("manager"), F.lit("; 備註: "), s("special_notes")),
        all_content=F.concat_ws(" ", c("product_id"), name, place, s("special_notes")),
        searchable_content=F.concat(F.lit("產品 "), c("product_id"), F.lit(" "), name, F.lit(" 倉庫 "), place, F.lit(" 數量 "), s("quantity")),
        product_ids=linking.own_first("product_id", "_ids"), warehouse_location=place, metadata=dynamic_fields(warehouse, metadata), updated_at=c("last_modified"))


def complaint_docs(complaints: DataFrame, products: DataFrame, pattern: str = linking.CODE, null_text: str = "None", columns: list[str] | None = None) -> DataFrame:
    """One document per complaint, with ``columns`` only if given; products are looked for in the texts only where a column shows them."""
    if columns and not {"product_ids", "metadata"} & set(columns):
        return _complaint_docs(complaints, complaints, null_text).select(*columns)
    rows = linking.with_links(complaints, complaints.select("complaint_id", "description"), products, pattern, "complaint_id", "description")
    out = _complaint_docs(rows.withColumnRenamed("_related", "related_products"), complaints, null_text)
    return out.select(*columns) if columns else out


#: What a document has beside its columns while the products that its names stand for are not written out in it.
LINKS = {"link_names": "array<string>", "link_parts": "array<struct<id: string, part: string>>"}


def folded_complaint_docs(complaints: DataFrame, products: DataFrame, pattern: str = linking.CODE, null_text: str = "None") -> DataFrame:
    """``complaint_docs`` with ``LINKS`` in place of the products that share a name: ``product_ids`` are those by code, and ``spread_docs`` adds the others.

    A document holds the names that stand in its text, so its size doesn't grow with the number of products of one name.
    """
    rows = linking.found_links(complaints, complaints.select("complaint_id", "description"), products, pattern, "complaint_id", "description").withColumnRenamed("_codes", "_ids")
    return _complaint_docs(rows, complaints, null_text, **{c: F.col(o) for c, o in zip(LINKS, ("_names", "_parts"))})


def spread_docs(docs: DataFrame, products: DataFrame) -> DataFrame:
    """Folded documents as whole ones; those without ``LINKS`` as they are."""
    rows = docs.withColumns({"_codes": F.when(F.col("link_parts").isNotNull(), F.col("product_ids")), "_parts": F.col("link_parts"), "_names": F.col("link_names")}).drop(*LINKS)
    found = linking.spread_links(rows, products, "_id")
    related = F.transform_values("metadata", lambda k, v: F.when(k == "related_products", F.col("_related")).otherwise(v))
    linked = F.col("_ids").isNotNull()
    return found.withColumns({"product_ids": F.when(linked, F.col("_ids")).otherwise(F.col("product_ids")), "metadata": F.when(linked, related).otherwise(F.col("metadata"))}).drop("_ids", "_related")


def _complaint_docs(rows: DataFrame, complaints: DataFrame, null_text: str, **more: Column) -> DataFrame:
    c = lambda name: _col(rows, name)
    s = lambda name: shown(c(name), null_text)
    key = F.concat(F.lit("complaint_"), c("complaint_id"))
    text = F.coalesce(c("description"), F.lit(""))
    metadata = _map(
        complaint_date=date_text(c("complaint_date")), customer_name=c("customer_name"), customer_company=c("customer_company"), complaint_type=c("complaint_type"),
        severity=c("severity"), handler=c("handler"), resolution_date=date_text(c("resolution_date")), related_products=c("related_products"))
    return _document(
        rows, _id=key, _index=F.lit("erp-complaints"), type=F.lit("complaint"), id=c("complaint_id"), doc_id=key,
        title=F.concat(F.lit("["), c("complaint_id"), F.lit("] "), s("customer_company"), F.lit(" - "), s("complaint_type"), F.lit(" ("), s("status"), F.lit(")")),
        content=text, all_content=F.concat_ws(" ", s("customer_name"), s("customer_company"), text, s("complaint_type")),
        searchable_content=F.concat(F.lit("客訴編號 "), c("complaint_id"), F.lit(" 客戶 "), s("customer_company"), F.lit(" 類型 "), s("complaint_type"), F.lit(" "), text),
        product_ids=F.coalesce(c("_ids").cast("array<string>") if "_ids" in rows.columns else F.lit(None).cast("array<string>"), F.array().cast("array<string>")), status=c("status"), severity=c("severity"), metadata=dynamic_fields(complaints, metadata), updated_at=c("last_modified"), **more)


def union_docs(*docs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), docs)


def embedding_text(docs: DataFrame, fields: tuple[str, ...] = ("field_description", "field_product_name", "field_complaint_type"), most: int = 8000) -> Column:
    """The text to embed: the non-empty fields joined, else ``all_content``; cut to ``most`` characters, the encoder's limit."""
    found = join_truthy(*[F.col("metadata")[f] if f not in docs.columns and "metadata" in docs.columns else _col(docs, f) for f in fields])
    return F.substring(F.coalesce(F.nullif(found, F.lit("")), F.col("all_content")), 1, most)

"""Schemas of the business tables and of the search documents."""

from __future__ import annotations

PRODUCTS = "product_id string, product_name string, product_model string, category string, price decimal(12,2), stock_qty int, manufacture_date date, supplier string, status string, last_modified timestamp"
WAREHOUSE = "product_id string, product_name string, warehouse_location string, quantity int, last_inventory_date date, manager string, special_notes string, min_stock_level int, last_modified timestamp"
COMPLAINTS = "complaint_id string, complaint_date date, customer_name string, customer_company string, complaint_type string, severity string, description string, handler string, status string, resolution_date date, last_modified timestamp"
QUERIES = "query_id bigint, query string, mode string, top_k int, index_pattern string, query_vector array<float>, convert_to_traditional boolean"

#: Index names and document types, by table.
INDEXES = {"product_master_a": "erp-products", "product_warehouse_b": "erp-warehouse", "customer_complaint_c": "erp-complaints"}
TYPES = {"erp-products": "product_master", "erp-warehouse": "warehouse", "erp-complaints": "complaint"}

#: Columns of a search document, in order.
DOCUMENT = {
    "_id": "string", "_index": "string", "type": "string", "id": "string", "doc_id": "string", "title": "string", "content": "string", "all_content": "string",
    "searchable_content": "string", "product_ids": "array<string>", "status": "string", "severity": "string", "warehouse_location": "string",
    "metadata": "map<string,string>", "updated_at": "timestamp", "content_vector": "array<float>", "vector_generated_at": "timestamp",
}

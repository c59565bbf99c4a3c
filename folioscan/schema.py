"""Schemas of the engine's tables (DDL strings)."""

PATCHES = "page_ord long, patch int, vec array<float>"
PAGE_META = "page_ord long, source string, page int, total_pages int, image_path string"
PAGE_VECTORS = "page_ord long, unit_vec array<float>"
QUERIES = "query_id long, query string, vec array<float>"
HITS = "query_id long, rank int, page_ord long, source string, page int, total_pages int, image_path string, similarity double"
ANSWERS = "query_id long, answer string, status string, error string, n_images int"
METADATA_JSON = "array<struct<source:string,page:int,total_pages:int>>"

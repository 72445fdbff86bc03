"""Schemas of the tables that operators read and write."""

DOCS = "collection string, doc_id string, source_name string, title string, markdown string, content_hash string, doc_type string, metadata map<string,string>"
CHUNKS = "doc_id string, chunk_index int, heading_path array<string>, page_or_section string, text string, char_count int"
GOLDEN = "question string, collection string, expected_doc string, expected_keywords array<string>"
ENTRIES = "archive string, entry string, size bigint, is_dir boolean, bytes binary, position int"
SEGMENTS = "video_id string, start double, duration double, text string"
FILES = "path string, modificationTime timestamp, length bigint, content binary"

"""Schemas of the engine's tables."""

FILES = "file_path string, sha256 string, mtime double, indexed_at timestamp, project_name string"
CHUNKS = (
    "chunk_id string, file_path string, language string, start_line int, end_line int, symbol_type string, symbol_name string, "
    "parent_class string, namespace string, content string, content_hash string, project_name string"
)
SYMBOLS = "symbol_type string, symbol_name string, parent_class string, namespace string, start_line int, end_line int, content string"
VECTORS = "chunk_id string, point_id decimal(20,0), vector array<float>, language string, symbol_type string, project_name string"
CACHE = "content_hash string, vector array<float>"
POSTINGS = "token string, chunk_id string, dl int, tf int, positions array<int>"
LENGTHS = "chunk_id string, dl int"

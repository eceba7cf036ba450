"""Schemas and fixed values of the engine's relations."""

from __future__ import annotations

FILES = (
    "file_id long, path string, file_type string, extension string, size_bytes long, modified_at timestamp, indexed_at timestamp, "
    "content_hash string, thumbnail_path string, basename string, parent string, stem string"
)
CHUNKS = "file_id long, vector_id string, chunk_index int, start_time double, end_time double, embedding array<float>, embedding_model string, embedding_dims int"
EVENTS = "path string, type string, ts timestamp"
FAILURES = "seq long, path string, code string, message string, attempts int, last_failed_at timestamp"
#: Bumped when a stored query specification can no longer be read.
SPEC_VERSION = 3

# Folder names left out of a new index; media types and kinds by extension.
DEFAULT_IGNORED = (
    "node_modules", ".git", "venv", ".venv", "__pycache__", ".mypy_cache", "dist", "build", ".next", ".nuxt",
    "out", "target", ".gradle", ".idea", ".vscode", "Pods", "vendor", ".cache", ".sass-cache", "coverage",
)
MEDIA_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif", ".gif": "image/gif",
    ".mp4": "video/mp4", ".mpeg": "video/mpeg", ".mpg": "video/mpeg", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".flv": "video/x-flv",
    ".webm": "video/webm", ".wmv": "video/x-ms-wmv", ".3gp": "video/3gpp",
    ".wav": "audio/wav", ".mp3": "audio/mpeg", ".aiff": "audio/aiff", ".aac": "audio/aac", ".ogg": "audio/ogg", ".flac": "audio/flac",
    ".pdf": "application/pdf",
}
OFFICE = (".docx", ".pptx", ".xlsx")
OLD_OFFICE = (".doc", ".ppt", ".xls", ".odt", ".odp", ".ods", ".rtf")
KINDS = {e: m.partition("/")[0] for e, m in MEDIA_TYPES.items() if e != ".pdf"} | {e: "document" for e in (".pdf", *OFFICE, *OLD_OFFICE)}

# Retry classes of error codes (others are Permanent), and what codes say.
RETRY = {
    "ERR_UNSUPPORTED_FORMAT": "Permanent", "ERR_EXTRACTION_FAILED": "Permanent", "ERR_FILE_TOO_LARGE": "Permanent", "ERR_FILE_UNREADABLE": "Permanent",
    "ERR_EMBED_COUNT_MISMATCH": "Permanent", "ERR_EMBED_FAILED": "TransientRetry", "ERR_HNSW_ADD": "TransientRetry", "ERR_STORE_WRITE": "TransientRetry",
    "ERR_RATE_LIMITED": "TransientWait",
}
LABELS = {
    "ERR_UNSUPPORTED_FORMAT": "file format is not supported for indexing", "ERR_EXTRACTION_FAILED": "text extraction from file failed",
    "ERR_FILE_TOO_LARGE": "file exceeds the maximum size for indexing", "ERR_FILE_UNREADABLE": "file could not be read",
    "ERR_EMBED_COUNT_MISMATCH": "embedding response count does not match chunk count", "ERR_HNSW_ADD": "failed to add vector to HNSW index",
    "ERR_STORE_WRITE": "failed to write to metadata store", "ERR_EMBED_FAILED": "embedding request failed", "ERR_RATE_LIMITED": "rate limited by embedding provider",
    "ERR_MODEL_MISMATCH": "index was built with a different embedding model — reindex required", "ERR_FOLDER_DENIED": "folder cannot be accessed",
    "ERR_STORE_LOCKED": "database is locked", "ERR_CONFIG_INVALID": "configuration is invalid", "ERR_MIGRATION_FAILED": "database migration failed", "ERR_INTERNAL": "internal error",
}

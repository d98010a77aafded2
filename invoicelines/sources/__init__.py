"""Reading and writing: documents, record files, result tables."""

from .readers import audit_files, read_documents, read_records
from .sinks import output_path, write_filtered, write_records, write_rejects, write_run, write_stats

__all__ = ["audit_files", "output_path", "read_documents", "read_records", "write_filtered", "write_records", "write_rejects", "write_run", "write_stats"]

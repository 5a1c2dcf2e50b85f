"""Reading and writing files."""

from .read import READERS, preview, read_rows, sound_file, source_status
from .write import FailureShareExceeded, provenance, publish, write_csv, write_jsonl, write_parquet

__all__ = ["READERS", "FailureShareExceeded", "preview", "provenance", "publish", "read_rows", "sound_file", "source_status", "write_csv", "write_jsonl", "write_parquet"]

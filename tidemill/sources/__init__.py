"""Reading and writing files and tables."""

from .files import file_stream, frame_from_columns, json_records, read_csv, read_csv_text, table
from .landing import landing_path, process_dates
from .sinks import (append_rows, drop_table, ensure_table, remove_folder, replace_parts, save_table, write_anomalies, write_json,
                    write_partitioned, write_stream)

__all__ = [
    "append_rows", "drop_table", "ensure_table", "file_stream", "frame_from_columns", "json_records",
    "landing_path", "process_dates", "read_csv", "read_csv_text", "remove_folder", "replace_parts", "save_table", "table",
    "write_anomalies", "write_json", "write_partitioned", "write_stream",
]

"""Online event detection on streams."""

from tracklake.streaming.online import detect_events_stream, process_stream
from tracklake.streaming.sources import drain, read_csv_stream, write_json_lines

__all__ = ["detect_events_stream", "drain", "process_stream", "read_csv_stream", "write_json_lines"]

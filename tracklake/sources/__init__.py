"""Reading and writing position files."""

from tracklake.sources.files import discover_files, scan_files, scan_many, scan_parquet, sniff_separator
from tracklake.sources.sinks import write_parquet, write_partitioned, write_table

__all__ = ["discover_files", "scan_files", "scan_many", "scan_parquet", "sniff_separator", "write_parquet", "write_partitioned", "write_table"]

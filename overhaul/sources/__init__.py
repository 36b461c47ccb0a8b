"""Table sources and sinks: Parquet datasets with fixed schemas."""

from overhaul.sources.tables import conform, export_json, read_table, read_tables, write_table

__all__ = ["read_table", "read_tables", "write_table", "conform", "export_json"]

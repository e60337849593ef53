"""Reading the tables of a folder."""

from quern.sources.tables import TABLES, read_table, register_tables

__all__ = ["TABLES", "read_table", "register_tables"]

"""Batch readers: files, JDBC tables, incremental reads, program rows."""

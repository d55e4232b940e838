"""Batch writers: tables, edge lists, JDBC tables, models."""

"""Column-expression builders; nothing here runs a job."""

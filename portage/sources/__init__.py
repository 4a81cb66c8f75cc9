"""Scans of Parquet and JDBC tables, and the catalog shapes."""

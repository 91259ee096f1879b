"""Readers and writers: Parquet, CSV, XML, JDBC, and bulk upserts."""

"""Scans: databases over JDBC, views already in Spark, delimited files and file listings."""

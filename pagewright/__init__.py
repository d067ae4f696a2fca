"""Workspace analytics on PySpark: pages to relations, links, history, change feeds."""

SCHEMA_VERSION = 1

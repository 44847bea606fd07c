"""Bulk website audit as PySpark DataFrame queries."""

"""Stratasift: content-inventory analytics on PySpark."""

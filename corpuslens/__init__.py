"""Content-audit analytics on PySpark."""

"""Versioned, content-addressed dataset analytics on PySpark."""

"""Wayfold: trajectory analytics, relational queries and streaming on PySpark."""

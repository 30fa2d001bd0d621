"""Weftwork: web-collection analytics and corpus preparation as PySpark dataflow."""

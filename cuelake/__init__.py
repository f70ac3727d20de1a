"""Timed-text and corpus analytics on PySpark."""

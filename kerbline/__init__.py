"""Shared-mobility analytics as PySpark DataFrame jobs."""

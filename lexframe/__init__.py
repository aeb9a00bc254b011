"""Statute retrieval, grounded answers and their evaluation as Spark DataFrame jobs."""

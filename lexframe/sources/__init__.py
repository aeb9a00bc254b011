"""Readers of landed JSON and writers of results. Everything goes through Spark's readers and writers."""

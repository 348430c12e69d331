"""Recommendation analytics on interaction logs, written as Spark DataFrame operators."""

"""Spark-first analytics for marketplace listings."""

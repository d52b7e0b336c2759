"""Quillon: literature and corpus analytics expressed as Spark DataFrame, SQL and Structured Streaming plans."""

"""Query-impact analytics on Spark."""

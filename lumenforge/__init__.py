"""lumenforge: Spark-first annotation, embedding, scoring and point-cloud analytics."""

"""Text-pipeline analytics on PySpark."""

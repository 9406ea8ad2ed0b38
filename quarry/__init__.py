"""quarry: scan-finding analytics and training-data operators on PySpark."""

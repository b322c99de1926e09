"""Vector-memory analytics on PySpark DataFrames."""

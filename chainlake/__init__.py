"""Event-sequence and training-data analytics on PySpark DataFrames."""

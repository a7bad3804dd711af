"""A small SQL analytics engine on PySpark DataFrames."""

"""Dimensional-warehouse operators on PySpark DataFrames."""

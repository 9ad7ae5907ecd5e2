"""Code-governance analytics on Spark: declared as DataFrames, planned by Catalyst."""

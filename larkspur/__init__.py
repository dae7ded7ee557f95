"""A PySpark document query engine: collections of JSON documents as DataFrames."""

"""Sighting-log and embedding-gallery analytics on PySpark DataFrames."""

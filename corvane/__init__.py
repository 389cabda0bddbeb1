"""Faceted search and corpus analytics on Spark DataFrames."""

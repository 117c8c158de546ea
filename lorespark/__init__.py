"""Provenance-aware text-corpus analytics on Spark DataFrames."""

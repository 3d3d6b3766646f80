"""Guarded table operations and corpus building on Spark DataFrames."""

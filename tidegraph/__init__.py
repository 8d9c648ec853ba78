"""Temporal property graphs as Spark DataFrames."""

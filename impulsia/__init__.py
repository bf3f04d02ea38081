"""Structural vector-autoregression analytics as Spark DataFrames."""

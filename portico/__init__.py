"""Portico: gate-camera analytics on Spark DataFrames."""

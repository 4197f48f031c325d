"""Acoustic similarity, calibration and streaming-decision analytics on Spark DataFrames."""

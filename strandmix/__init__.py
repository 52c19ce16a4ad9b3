"""Mixture analytics for multichannel time series, on Spark DataFrames."""

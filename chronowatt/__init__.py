"""chronowatt: energy and air-quality time-series analytics written for Spark DataFrames."""

__version__ = "0.1.0"

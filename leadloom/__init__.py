"""Lead sourcing and sales-pipeline analytics on Spark DataFrames."""

__version__ = "0.1.0"

"""tidewright: data preparation and exploratory analytics on Spark DataFrames."""

__version__ = "0.1.0"

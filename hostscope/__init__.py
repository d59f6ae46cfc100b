"""hostscope: host and URL intelligence on Spark DataFrames."""

__version__ = "0.1.0"

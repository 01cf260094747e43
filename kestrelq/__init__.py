"""kestrelq: a small analytical SQL engine expressed entirely on Spark DataFrames and Catalyst."""

__version__ = "0.1.0"

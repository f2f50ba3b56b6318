"""larder: order analytics and record preparation on Spark DataFrames."""

__version__ = "0.1.0"

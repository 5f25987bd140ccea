"""Text segmentation and tree queries on Spark DataFrames."""

__version__ = "0.1.0"

"""Key-log storage and search on Spark: DataFrames, Catalyst expressions and Parquet only."""

__version__ = "0.1.0"

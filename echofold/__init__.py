"""Duplicate-content analytics over file inventories, built on Spark DataFrames."""

__version__ = "0.1.0"

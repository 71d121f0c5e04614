"""Loadloom: load-profile analytics and large-table operators on Spark DataFrames."""

__version__ = "0.1.0"

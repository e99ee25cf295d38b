"""navloom: mutual-fund analytics as Spark DataFrame jobs.

Every job is a function of DataFrames and parameters that returns a lazy
DataFrame. Dates such as ``as_of`` are always passed in. A value that cannot be
known is null, never 0.
"""

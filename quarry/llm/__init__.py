"""Training-data operators: ten corpus operators on Spark DataFrames.

Nothing outside this package imports it.
"""

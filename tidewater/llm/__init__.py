"""Operations of a training-data pipeline, each on Spark DataFrames.

One module holds one operator; ``queries`` registers them.  Nothing outside
this subpackage imports it.
"""

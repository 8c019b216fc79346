"""A multi-model data engine on Spark DataFrames."""

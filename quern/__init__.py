"""Quern: a semantic-model analytics engine on Spark DataFrames."""

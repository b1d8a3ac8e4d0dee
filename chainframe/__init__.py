"""Chainframe: ordered-event analytics and simulation on Spark DataFrames."""

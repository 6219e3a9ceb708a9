"""The read queries, each a function from table DataFrames to one DataFrame."""

"""DataFrame operators: each is a pure function of DataFrames to a DataFrame."""

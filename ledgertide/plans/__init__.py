"""Named analytics: each function takes DataFrames and returns lazy DataFrames."""

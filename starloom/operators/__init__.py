"""Set-based operators on DataFrames. Column names are always parameters."""

"""Layout-aware text analytics on Spark DataFrames."""

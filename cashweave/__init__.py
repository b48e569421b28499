"""Cash-flow analytics for many small businesses at once, on Spark DataFrames."""

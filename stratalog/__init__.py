"""Analytics over the history of file trees, written for Spark DataFrames."""

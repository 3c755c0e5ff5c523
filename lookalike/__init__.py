"""lookalike: find and measure copying between documents with Spark DataFrames."""

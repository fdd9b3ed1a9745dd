"""Bar analytics and strategy falsification on Spark DataFrames."""

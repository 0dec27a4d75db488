"""Analytics on time-ordered observation data, as Spark DataFrames."""

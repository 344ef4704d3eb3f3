"""Analytics of alignment data and model evaluation on Spark DataFrames."""

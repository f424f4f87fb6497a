"""Photo-session analytics and training-data operators on Spark DataFrames."""

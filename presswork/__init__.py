"""presswork: text, web and training-data analytics on Spark DataFrames."""

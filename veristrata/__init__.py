"""Evidence-backed document analytics on Spark DataFrames."""

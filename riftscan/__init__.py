"""riftscan: change-risk analytics and corpus preparation on Spark DataFrames."""

"""fieldloom: exact matrix analytics on Spark DataFrames."""

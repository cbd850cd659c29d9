"""gridstone: designed-experiment response analytics on Spark DataFrames."""

"""Web-archive analytics as Spark DataFrames."""

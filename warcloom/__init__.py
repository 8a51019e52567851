"""Web-archive analytics expressed as Spark DataFrames."""

"""Vector similarity search and analytics over Spark DataFrames."""

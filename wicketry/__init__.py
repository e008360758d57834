"""Ball-by-ball cricket analytics as lazy Spark DataFrames."""

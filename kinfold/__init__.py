"""Entity resolution over personal names and a star-schema warehouse, built on Spark DataFrames."""

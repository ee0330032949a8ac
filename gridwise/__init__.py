"""gridwise: geospatial lead analytics on Spark DataFrames."""

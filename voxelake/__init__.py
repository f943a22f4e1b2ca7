"""A point-cloud store, spatial query engine and tile renderer on Spark DataFrames."""

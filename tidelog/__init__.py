"""A versioned keyed-log engine on Spark DataFrames."""

"""Table profiling and preparation on Spark DataFrames."""

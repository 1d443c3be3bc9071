"""tidalframe: time-series analytics over long Spark DataFrames keyed by series."""

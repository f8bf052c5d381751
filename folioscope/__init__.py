"""folioscope: evidence analytics on Spark DataFrames."""

"""dqspark: data-quality profiling, series analytics and rule proposal on Spark DataFrames."""

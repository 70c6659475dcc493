"""Table reconciliation and incremental aggregation on Spark DataFrames."""

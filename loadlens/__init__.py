"""loadlens: load-balance and performance-trace analytics on Spark DataFrames."""

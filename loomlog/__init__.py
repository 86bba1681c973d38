"""loomlog: log and telemetry analytics on Spark DataFrames."""

"""Text pseudonymisation and re-identification measurement on Spark DataFrames."""

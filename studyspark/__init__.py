"""Study-note analytics as plain functions from Spark DataFrames to Spark DataFrames."""

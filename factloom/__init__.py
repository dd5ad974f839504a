"""Evidence-checked knowledge graphs on Spark DataFrames."""

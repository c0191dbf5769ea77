"""Shape-pattern analytics for graphs with 2D coordinates, on Spark DataFrames."""

"""gridstone: indexed vectors, arrays and matrices as Spark DataFrames."""

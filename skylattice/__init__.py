"""Map algebra over lattices of cells, on Spark DataFrames."""

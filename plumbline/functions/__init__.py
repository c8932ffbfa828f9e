"""Column functions: they work alike on batch and streaming DataFrames."""

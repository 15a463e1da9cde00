"""Column functions: text parsing and scores. All are built-in expressions; none is a UDF."""

"""Column functions. Everything here is built-in expressions, no Python UDF."""

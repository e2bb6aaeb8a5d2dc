"""Column functions: text, codes, numbers, URLs. Everything here is a native Spark expression."""

"""Column expressions; each one stays inside Spark's generated code."""

"""Column expressions: everything here stays inside Spark's own code generation."""

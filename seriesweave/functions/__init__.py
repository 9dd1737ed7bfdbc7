"""Column builders: pure expressions that stay inside Spark's code generation."""

"""Column expressions that stay inside generated code."""

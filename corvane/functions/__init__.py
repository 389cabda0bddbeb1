"""Column expressions over text and names."""

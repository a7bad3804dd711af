"""The SQL dialect: text to syntax tree, logical plan, and DataFrame."""

"""Column functions: text, quality scoring, geometry."""

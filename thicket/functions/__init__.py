"""Column functions: extraction, judging, scoring, text rendering."""

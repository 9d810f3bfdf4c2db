"""Column functions: text, numbers, JSON, rendering."""

"""Column factories: text, scoring and URL functions."""

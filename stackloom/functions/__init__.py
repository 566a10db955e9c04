"""Column functions on text, numbers and dates."""

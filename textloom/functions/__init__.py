"""Column functions over text, dates and arrays."""

"""Column functions over arrays and text."""

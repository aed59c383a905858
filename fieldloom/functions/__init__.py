"""Column functions: text, JSON values and page content."""

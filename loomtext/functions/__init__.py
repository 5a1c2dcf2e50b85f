"""Column functions for text, dates, JSON and type inference."""

"""Column functions: text to typed facts."""

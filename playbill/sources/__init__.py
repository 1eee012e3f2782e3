"""Reading pages, feeds, dimensions, editions and the staged table."""

"""Complete queries over the tables at hand."""

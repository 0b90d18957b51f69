"""Readers.  Each returns a DataFrame with a fixed set of columns and runs no job of its own."""

"""Structured Streaming jobs.  Each micro-batch goes through the functions that batch jobs call."""

"""cuelake: timed-text and usage analytics on Spark."""

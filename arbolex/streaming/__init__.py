"""Structured Streaming forms of tokenising, counting, batching and the running loss."""

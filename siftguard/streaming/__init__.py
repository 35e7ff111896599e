"""Structured Streaming variants. They use the same column expressions as the batch scan."""

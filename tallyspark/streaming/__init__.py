"""The same pipeline over Structured Streaming."""

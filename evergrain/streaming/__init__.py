"""Change-driven operators on Structured Streaming."""

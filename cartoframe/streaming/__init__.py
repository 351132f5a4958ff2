"""Change-feed maintenance with Structured Streaming."""

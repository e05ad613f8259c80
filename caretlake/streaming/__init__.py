"""Structured Streaming forms of the replay, of completion and of the traffic report."""

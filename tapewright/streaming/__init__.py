"""Structured Streaming: live bars, features with bounded state, scores and sinks."""

"""Structured Streaming jobs: each processes what is available, then stops."""

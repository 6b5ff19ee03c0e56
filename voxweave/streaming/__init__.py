"""Structured Streaming jobs and the time-based operators they share with batch."""

"""Structured Streaming form of the hourly cleaning job."""

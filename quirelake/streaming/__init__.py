"""Structured Streaming forms of the job queue and the landing folder."""

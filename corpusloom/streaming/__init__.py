"""Streaming of corpusloom."""

"""Structured Streaming form of the social feed."""

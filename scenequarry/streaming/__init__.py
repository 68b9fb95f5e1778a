"""Streaming of the scene engine."""

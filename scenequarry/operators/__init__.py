"""Operators of the scene engine."""

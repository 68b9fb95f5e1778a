"""Sources of the scene engine."""

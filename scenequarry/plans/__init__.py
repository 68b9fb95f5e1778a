"""Plans of the scene engine."""

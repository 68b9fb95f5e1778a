"""Spark-native analytics for corpora of captured 3D scenes."""

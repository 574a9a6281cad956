"""Spark-native analytics for sparse movement trajectories."""

"""Trajectory and travel-demand analytics as Spark DataFrame operators."""

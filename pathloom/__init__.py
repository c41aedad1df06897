"""Labelled-graph path and kernel analytics as Spark DataFrame plans."""

"""Belief-graph analytics as Spark plans."""

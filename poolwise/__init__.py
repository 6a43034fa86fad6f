"""Poolwise: evaluation and mining of candidate pools on Spark."""

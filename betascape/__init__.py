"""Pairwise compositional-turnover analytics on Spark."""

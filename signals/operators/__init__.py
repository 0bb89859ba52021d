"""Relational and statistical operators of the scoring model (DataFrame in, DataFrame out)."""

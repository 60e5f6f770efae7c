"""Regression, causal and clustering models as distributed table jobs."""

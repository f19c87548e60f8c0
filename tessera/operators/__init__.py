"""Relational, search, catalog, evaluation, result and analytic operators."""

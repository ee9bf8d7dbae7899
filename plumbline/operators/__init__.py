"""Relational building blocks of the estimator."""

"""Scalar functions that operators and queries share."""

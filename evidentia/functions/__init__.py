"""Scalar functions and predicates as column expressions."""

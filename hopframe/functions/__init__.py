"""Predicates and literals."""

"""Parsing, the ordered step list, graph mappings and explain."""

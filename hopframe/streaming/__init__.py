"""Keeping cached tables fresh, and queries over tables that still grow."""

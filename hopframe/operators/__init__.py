"""The compiler from ordered steps to DataFrame operations."""

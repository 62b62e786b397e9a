"""Operators for building training data, and their contract queries."""

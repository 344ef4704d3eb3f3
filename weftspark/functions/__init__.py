"""Expressions and calls of outside models."""

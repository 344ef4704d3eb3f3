"""Operators on DataFrames of conversations, preferences and judgments."""

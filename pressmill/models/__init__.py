"""Scoring models: each has a name, a version, and gives a DataFrame of analysis rows."""

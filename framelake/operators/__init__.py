"""Operators: DataFrame to DataFrame, by topic."""

"""Operators of the diff and rule engine over DataFrames."""

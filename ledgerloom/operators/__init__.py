"""Operators over DataFrames; each module is one family."""

"""Inputs are finite tables; datasets over streaming DataFrames take constraints, computed columns and projection lists,
which keep no state, and are written with ``writeStream`` on ``Dataset.df``."""

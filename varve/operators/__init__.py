"""Operators of the data model, each a function of DataFrames."""

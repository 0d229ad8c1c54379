"""Operators on DataFrames: windows, spatial joins, curation, search, transfer, evaluation, learning."""

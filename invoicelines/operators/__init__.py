"""Operators on DataFrames: text, layouts, blocks, records."""

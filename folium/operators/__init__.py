"""Operators on DataFrames: segmentation, layout, matching, grades, search, publishing."""

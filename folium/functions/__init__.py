"""Scalar functions on columns: text repair, dates, numbers, citations."""

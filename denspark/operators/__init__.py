"""Operators on tables of points, cells and links."""

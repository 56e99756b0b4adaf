"""Grids that arrive as streams."""

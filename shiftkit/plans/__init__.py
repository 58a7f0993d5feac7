"""Whole experiments as tables: the grid, what is done, and the flagship question."""

"""Labelled tables, results and profiles: reading and writing."""

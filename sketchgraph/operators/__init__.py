"""Operators on scenes."""

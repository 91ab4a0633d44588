"""Scenes that arrive over time."""

"""Streams of grid cells through the row-local operators."""

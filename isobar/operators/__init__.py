"""Operators on cubes, series, samples and tracks."""

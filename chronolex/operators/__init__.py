"""Operators on cubes, windows, features and models."""

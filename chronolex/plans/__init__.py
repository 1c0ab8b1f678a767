"""Chronolex plans."""

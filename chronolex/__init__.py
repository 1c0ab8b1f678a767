"""Chronolex: how multi-word expressions behave over time in large corpora, as Spark plans."""

"""Readers and writers of the formats that corpora and features come in."""

"""Column functions for text, tags, languages and ratings."""

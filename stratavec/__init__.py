"""Vector search, clustering and their evaluation as DataFrame plans."""

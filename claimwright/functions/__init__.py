"""Column-level functions: names, similarity, text, confidence."""

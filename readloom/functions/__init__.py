"""Column functions over sequences, and probability tables."""

"""Training-data operators on document records, and their queries over the given tables."""

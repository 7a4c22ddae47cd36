"""Training-data operators: tokenizing, filtering, deduplication, privacy and output."""

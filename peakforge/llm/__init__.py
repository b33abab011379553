"""Training-data operators: archives, filters, near-duplicates, mixing and token output."""

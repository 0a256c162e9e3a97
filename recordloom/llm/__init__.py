"""Training-data operators: mixing, scanning, cleaning, deduplication and output."""

"""Training-data operators: deduplication, scoring, tokenising, filtering and packing of documents."""

"""Training-data operators: deduplication, filtering, search, mixing, packing.

Nothing else in the package imports this subpackage. ``queries`` registers one
query per operator over the provided tables."""

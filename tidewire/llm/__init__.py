"""Training-data operators: deduplication, sharding, quality, packing,
tokenisation, archives, fingerprints and chat formatting.

Nothing else in the package imports this subpackage."""

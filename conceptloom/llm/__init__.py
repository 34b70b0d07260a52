"""Training-data operators: sharding, scoring, packing, near-duplicates, mixing, formatting, media, licences, fingerprints."""

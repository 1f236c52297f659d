"""Operations of a training-data pipeline: sharding, mixing, encoding, filtering, deduplication and search."""

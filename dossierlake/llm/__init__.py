"""Operations of a training-data pipeline: scoring, filtering, deduplication, mixing, packing, search and output."""

"""varlens.sources."""

"""varlens.streaming."""

"""varlens.functions."""

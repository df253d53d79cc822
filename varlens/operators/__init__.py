"""varlens.operators."""

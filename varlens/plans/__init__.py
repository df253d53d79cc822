"""varlens.plans."""

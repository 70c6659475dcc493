"""Part of the reconciliation engine."""

"""Whole flows: documents in, checked results out; and the registered queries."""

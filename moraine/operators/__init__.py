"""Operators over stored tables: catalogues, tensors, runs, vetting, windows and sets."""

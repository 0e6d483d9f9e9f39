"""Helpers that shape physical plans: shared storage, tiling."""

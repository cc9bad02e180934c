"""Inputs: table and LibSVM sources, row preparation, the prepared design."""

"""Iterative fits (driver loops of single-pass aggregates), presets and stock baselines."""

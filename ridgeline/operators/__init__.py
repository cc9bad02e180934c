"""Single-pass aggregates and per-row evaluation over a design."""

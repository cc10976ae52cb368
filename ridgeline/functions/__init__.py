"""Column expressions: masks, per-cell physics, geometry, arrays, identity."""

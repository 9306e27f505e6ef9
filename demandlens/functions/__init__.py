"""Scalar column helpers: the numeric contract (exact sums, guarded division, rounding)
and calendar attributes."""

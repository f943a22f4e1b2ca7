"""Scalar functions as Column expressions, with numpy twins for what the driver computes on metadata."""

"""Geometry predicates, index builds, aggregations and image pyramids."""

"""Scalar functions on documents: JSON paths, typed equality, numbering."""

"""Scalar functions as Column expressions: text, time, scores and vectors, JSON."""

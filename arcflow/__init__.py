"""Weighted finite-state transducers as relations, on PySpark.

A collection of transducers is two DataFrames, arcs and states, keyed by fst_id, so every operator works on one large
machine or on millions of small ones in the same jobs.
"""

"""Operators for large text corpora: one module for each operator, ``queries`` registers them."""

"""Operators for training-data pipelines: one module each, plus `queries` that registers them."""

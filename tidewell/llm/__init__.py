"""Operators for training-data pipelines; nothing else in tidewell imports them."""

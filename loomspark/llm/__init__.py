"""Operators for training data over text and large numeric columns."""

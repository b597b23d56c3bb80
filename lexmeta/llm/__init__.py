"""Operators for training data made of text: problems 2 to 9. Nothing outside this folder imports it."""

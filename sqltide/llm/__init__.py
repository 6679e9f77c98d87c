"""Operators on text corpora for training data; nothing outside this folder imports them."""

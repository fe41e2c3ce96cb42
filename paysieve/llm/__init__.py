"""Operators over corpora of documents for training data. Nothing outside this folder imports it."""

"""Operators for preparing language-model training data; nothing else in dqspark imports them."""

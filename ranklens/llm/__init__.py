"""Operators for preparing training data of language models. Nothing else in the package imports this."""

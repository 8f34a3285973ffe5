"""Operators for preparing language-model training data (a subpackage on its own)."""

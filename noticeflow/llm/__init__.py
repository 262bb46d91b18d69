"""Operators that turn raw documents into language-model training data.

Nothing else in the library imports this subpackage.
"""

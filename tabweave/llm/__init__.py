"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` applies them to the driver tables.
Nothing else in the library imports this subpackage.
"""

"""Operators for preparing training data: ten operators, each in a module of its own.

Nothing else in the library imports this package.
"""

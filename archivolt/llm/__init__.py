"""Operators for training data: one module each, their registered queries in ``queries``.

Nothing else in the package imports this folder.
"""

"""Operators for preparing language-model training data.

Nothing else in the package imports this one; the folder can be deleted as a whole.
"""

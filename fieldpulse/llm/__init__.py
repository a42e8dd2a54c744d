"""Operators for preparing text for language-model training.

Nothing else in the library imports this package. Column names of the input are
parameters; every operator picks the columns it needs first, so that further columns
of any name do no harm.
"""

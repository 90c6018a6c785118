"""Operators for training-data pipelines: one module per operator.

Nothing outside this package imports it.  ``queries`` registers one thin
query per operator; the operators keep their own general interfaces.
"""

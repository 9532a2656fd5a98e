"""Operators for preparing training data: an optional add-on that nothing else in the package imports."""

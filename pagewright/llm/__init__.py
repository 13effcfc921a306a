"""Operators for preparing text corpora; see README.md for what each one does.

Nothing else in pagewright imports this subpackage.
"""

"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Modules are loaded one by one so
that a Python worker only imports what its task needs.
"""

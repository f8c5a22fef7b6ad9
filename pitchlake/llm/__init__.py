"""Operators for training corpora.  Nothing outside this package imports it.

Column names that begin with an underscore are the operators' own: an input column of such a name may be replaced.
"""

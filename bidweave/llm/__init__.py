"""Operators of a training-data pipeline over documents, conversations and licences.

Nothing else in the library imports this subpackage.
"""

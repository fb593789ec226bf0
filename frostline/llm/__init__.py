"""Operators over training documents. Nothing else in the library imports this subpackage."""

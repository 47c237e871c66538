"""Operators for corpora and for records written by people; nothing else in the library imports this package."""

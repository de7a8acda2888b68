"""Puts the repository root on the import path of the tests."""

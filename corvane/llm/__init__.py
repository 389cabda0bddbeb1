"""Operators for preparing training text, each usable on any DataFrame.

Nothing outside this subpackage imports it.
"""

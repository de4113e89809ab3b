"""Operators for preparing training text, with their registered queries.

Nothing else in the library imports this subpackage. It uses the library's
general helpers (scratch tables, connected components).
"""

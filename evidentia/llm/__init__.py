"""Operators for preparing training text.

Nothing outside this package imports it.  ``queries.py`` binds every operator
to its production table, ``oracle.py`` holds the SQL twins.
"""

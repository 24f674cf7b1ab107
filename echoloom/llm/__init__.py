"""Operators for preparing training text. Nothing outside this package imports it, except the guarded hook in __spark_entry__."""

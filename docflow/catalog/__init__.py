"""Registered queries: the operators over the given tables, each with its SQL twin.

An entry is ``name: (query, sql)``; ``sql`` is None where SQL cannot say it or
would be too slow on whole tables. Those are tested against brute force.
"""

"""Training-data operators: ten of them, each in a module of its own, and the queries that apply them.

Nothing outside this subpackage imports it.
"""

"""Operators for large training corpora.

Nothing outside this subpackage imports it; ``queries`` lists the queries that
the driver contract registers.
"""

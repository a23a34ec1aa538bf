"""Operators for preparing training data at scale.

Each module holds one operator. ``entry`` registers the queries that the
driver runs. Nothing outside this subpackage imports it.
"""

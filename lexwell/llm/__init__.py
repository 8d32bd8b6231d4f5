"""Operators for preparing large text collections (ten problems, p1 to p10).

Nothing outside this subpackage imports it; it may be removed without touching the search engine.
"""

"""Operators for large training corpora: thirteen stages that stand on their own.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""

"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; :mod:`lynceus.llm.queries` registers the thin queries.
"""

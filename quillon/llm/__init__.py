"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in the library imports this subpackage.  Each
module holds one operator with a general interface and the thin ``opN_*`` query
that digests its output; ``registry`` collects the queries and their SQL.
"""

"""Training-data operators: filtering, deduplication, mixing and tokenisation of web-scale text.

Every module holds one operator with a general interface and the thin ``opN_*``
query over the standard tables.  ``registry`` gathers queries and oracle SQL.
Nothing outside this subpackage imports it.
"""

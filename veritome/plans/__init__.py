"""Queries over the standard tables, one per operator, each with its SQL where SQL has the semantics."""

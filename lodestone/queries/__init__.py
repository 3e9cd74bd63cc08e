"""Registered queries of the operators over the given tables, each with its SQL where one exists."""

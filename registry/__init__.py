"""Registered queries: one per operator, with the SQL that gives the same result."""

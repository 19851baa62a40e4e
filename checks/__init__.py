"""Registered queries over the given tables, with the SQL that must give the same rows."""

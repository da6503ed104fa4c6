"""Registered queries with the SQL that they must agree with."""

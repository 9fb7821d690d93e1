"""Registered queries and the SQL that each is compared with."""

"""Relational operators: discovery, change detection, redaction, joins, reports."""

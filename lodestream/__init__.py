"""Lodestream: session, event and document processing as Spark DataFrame jobs."""

"""Readers: Python data sources and file-based scans."""

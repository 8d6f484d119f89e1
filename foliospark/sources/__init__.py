"""Scans, text files, settings and provider interfaces."""

"""Readers for messy files, and the checks made before reading."""

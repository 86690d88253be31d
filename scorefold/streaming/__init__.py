"""Incremental evaluation of arriving prediction files."""

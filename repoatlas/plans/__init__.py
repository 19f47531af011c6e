"""Whole jobs: tables in, tables out."""

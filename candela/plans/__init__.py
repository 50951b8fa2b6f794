"""Whole scans and the queries that apply each operator."""

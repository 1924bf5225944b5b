"""Refreshing the readings table from newly landed payloads."""

"""Landed payloads, their parsers, the table sink and the test-table binding."""

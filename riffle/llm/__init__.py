"""Operators for preparing training data: search, filters, packing, token files, joins and mixing."""

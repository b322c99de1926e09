"""Operators for preparing training text: packing, token counts, chat format,
quality, deduplication, scoring, decontamination and media columns.

Nothing else in the package imports this subpackage.
"""

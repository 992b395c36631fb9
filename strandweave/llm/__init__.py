"""Training-data operators: de-duplication, extraction, tokenising, packing, scoring.

Nothing outside this subpackage imports it.
"""

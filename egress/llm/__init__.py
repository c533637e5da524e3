"""Training-data operators: packing, token files, dedup, scoring, scans, chat.

Nothing outside this subpackage imports it.
"""

"""Training-data operators: mixing, packing, near-duplicates, filters, search and archives.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames.
"""

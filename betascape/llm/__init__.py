"""Training-data operators: search, near-duplicate detection, tokenising, packing and filtering.

Every operator takes DataFrames and returns DataFrames, names the columns it needs and ignores
others, and treats a null text as an empty one.  Nothing outside this subpackage imports it.
"""

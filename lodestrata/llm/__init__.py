"""Training-data pipeline operators: dedup, quality, safety, packing, mixing, archives.

Nothing outside this subpackage imports it; deleting it leaves the rest whole.
"""

"""Training-data operators: formatting, archives, filters, deduplication, mixing, packing.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
